"""URL filter by the ratio of two character language models.

Rules (host, path, verdict) decide the URLs they fit; the longest fitting rule wins. The URLs that rules allow and
block are the training texts of two models. Each predicts a character from up to ORDER before it: counts of the
longest context are mixed with the prediction of the next shorter one by Witten-Bell weights, down to a flat one, so
the order that counts varies with what the corpus has seen. A URL's score is the mean over its characters of the
difference of log likelihoods; a threshold calibrated on held-out rule-decided URLs, a fifth of them, parts what stays.

All native. Windows of ORDER + 1 characters are counted before any shuffle; shorter contexts are sums of longer ones. The
model is a table of distinct windows, joined by a shuffle, as it grows with the corpus; windows that hold a thousandth of all rows or more, such as that at the start of every URL,
are OFTEN at most, so these are broadcast and their rows stay where they are. The driver gets one
histogram of at most 2 * 2001 rows.

Defined cases: a null URL, or one without "://", has an empty host and path and the text that it is; an empty text
scores 0; a very long URL is scored whole, in linear time; scores that tie with the threshold are allowed, and of fitting rules of equal length the last listed wins; without training texts of both verdicts every score is 0 and the threshold 0, so all is allowed; repeated rows are
judged each and count each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import let

ORDER = 4
FLAT = 1.0 / 256
HELD_OUT = 5
OFTEN = 1000
LARGE, SMALL = 4096, 64  # characters of the pieces that windows are cut from
SCALE = 100
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: Column) -> Column:
    """struct of the lower-cased host and of the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = let(rest, lambda r: F.struct(F.regexp_extract(r, "^[^/?#]*", 0).alias("h"), r.alias("r")))
    return let(raw, lambda x: F.struct(F.translate(x["h"], UPPER, LOWER).alias("host"), F.regexp_extract(F.substring(x["r"], F.length(x["h"]) + 1, F.length(x["r"])), "^[^?#]*", 0).alias("path")))


def fitting(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct rule, verdict of the longest rule that fits; null where none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        best = F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(best)
    return best


def cuts(text: Column, size: int, overlap: int) -> Column:
    """Pieces of a text that begin every `size` characters and reach `overlap` characters into the next."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - overlap - 1) / size), F.lit(0)).cast("int")), lambda b: F.substring(text, b * size + 1, F.lit(size + overlap)))


def windows(text: Column) -> Column:
    """Every character with the ORDER before it; the start is padded. Long texts are cut in large pieces, these in small ones, so that no window is looked for from the start."""
    padded = F.concat(F.lit("\x02" * ORDER), text, F.lit("\x03"))
    small = F.flatten(F.transform(cuts(padded, LARGE, ORDER), lambda p: cuts(p, SMALL, ORDER)))
    each = F.flatten(F.transform(small, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - ORDER), lambda i: F.substring(p, i, F.lit(ORDER + 1)))))
    return F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<string>"))


def _tail(c: Column, n: int) -> Column:
    return F.substring(c, -n, n)


def model(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grams (gram, ca, cb) and contexts (context, na, ta, nb, tb) of all orders, from rows of text and allowed."""
    longest = train.select("allowed", F.explode(windows(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count_if(F.col("allowed")).alias("ca"), F.count_if(~F.col("allowed")).alias("cb"))
    longest = written(longest, "url-windows")
    orders = [longest.withColumn("k", F.lit(ORDER + 1))]
    for k in range(ORDER, 0, -1):
        orders.append(longest.groupBy(_tail(F.col("gram"), k).alias("gram")).agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb")).withColumn("k", F.lit(k)))
    grams = orders[0]
    for o in orders[1:]:
        grams = grams.unionByName(o)
    grams = written(grams, "url-grams")
    context = F.substring("gram", F.lit(1), F.col("k") - 1)
    contexts = grams.groupBy("k", context.alias("context")).agg(F.sum("ca").alias("na"), F.count_if(F.col("ca") > 0).alias("ta"), F.sum("cb").alias("nb"), F.count_if(F.col("cb") > 0).alias("tb"))
    return grams, contexts


def ratios(distinct: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """w and llr, the difference of the models' log likelihoods of its last character, for each window w.

    Order by order over distinct grams: a gram takes the prediction of its tail, one character shorter. A tail or a
    context has as many grams as there are characters at most, so no key is frequent.
    """
    shorter = None
    for k in range(1, ORDER + 2):
        own = distinct.select(_tail(F.col("w"), k).alias("gram")).distinct().withColumn("context", F.substring("gram", 1, k - 1)).withColumn("tail", F.substring("gram", 2, k))
        met = own.join(grams.filter(F.col("k") == k).select("gram", "ca", "cb"), "gram", "left").join(contexts.filter(F.col("k") == k).drop("k"), "context", "left")
        if shorter is not None:
            met = met.join(shorter, "tail")
        else:
            met = met.withColumn("qa", F.lit(FLAT)).withColumn("qb", F.lit(FLAT))

        def chance(c: str, n: str, t: str, q: str) -> Column:
            return F.when(F.col(n) > 0, (F.coalesce(F.col(c), F.lit(0)) + F.col(t) * F.col(q)) / (F.col(n) + F.col(t))).otherwise(F.col(q))

        shorter = met.select(F.col("gram").alias("tail"), chance("ca", "na", "ta", "qa").alias("qa"), chance("cb", "nb", "tb", "qb").alias("qb"))
    return shorter.select(F.col("tail").alias("w"), (F.log("qa") - F.log("qb")).alias("llr"))


def threshold(scored: DataFrame) -> float:
    """Where rows of score and allowed part best: the middle of the best cuts by balanced accuracy; 0 without both kinds."""
    bin_ = F.greatest(F.least(F.floor(F.col("score") * SCALE), F.lit(1000)), F.lit(-1000)).cast("int")
    seen = {(r[0], r[1]): r[2] for r in scored.groupBy(bin_.alias("b"), "allowed").count().collect()}
    good, bad = (sum(n for (_, a), n in seen.items() if a is x) for x in (True, False))
    if not good or not bad:
        return 0.0
    best, cuts, over, under = -1.0, [], good, 0
    for b in range(-1000, 1002):
        value = over / good + under / bad
        if value > best + 1e-12:
            best, cuts = value, [b]
        elif value > best - 1e-12:
            cuts.append(b)
        over -= seen.get((b, True), 0)
        under += seen.get((b, False), 0)
    return (cuts[0] + cuts[-1]) / 2 / SCALE


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple = RULES) -> DataFrame:
    """key, host, path, rule, verdict, score of every row."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    text = F.translate(F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(u), UPPER, LOWER)
    cut_up = pages.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), host_and_path(u).alias("p"), text.alias("text"))
    split = cut_up.select("key", "row", "p.host", "p.path", "text").withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    rows = written(split.withColumn("allowed", F.col("fit.verdict") == "allow").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0), "url-rows")
    train = rows.filter(F.col("allowed").isNotNull() & ~F.col("held"))
    both = train.agg(F.max("allowed"), F.min("allowed")).first()
    if both[0] is not True or both[1] is not False:
        return rows.select(F.col("key").alias(key), "host", "path", "fit.rule", F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    grams, contexts = model(train)
    undecided = rows.filter(F.col("held") | F.col("allowed").isNull())
    shown = undecided.select("row", F.explode(windows(F.col("text"))).alias("w")).groupBy("row", "w").count()
    weights = written(shown.groupBy("w").agg(F.count("*").alias("pages")), "url-windows")
    total = weights.agg(F.sum("pages")).first()[0] or 0
    ratio = written(ratios(weights.select("w"), grams, contexts).join(weights, "w"), "url-ratios")
    often = F.col("pages") * OFTEN >= total  # OFTEN windows at most
    hot = ratio.filter(often).select("w", F.col("llr").alias("hot"))
    met = shown.join(F.broadcast(hot), "w", "left").withColumn("k", F.when(F.col("hot").isNull(), F.col("w")).otherwise(F.concat(F.lit("\x00"), F.col("row").cast("string"))))
    met = met.join(ratio.filter(~often).select(F.col("w").alias("k"), "llr"), "k", "left").withColumn("llr", F.coalesce("hot", "llr"))
    scores = written(met.groupBy("row").agg((F.sum(F.col("llr") * F.col("count")) / F.sum("count")).alias("score")), "url-scores")
    cut = threshold(rows.filter(F.col("held") & F.col("allowed").isNotNull()).join(scores, "row").select("score", "allowed"))
    out = rows.join(scores, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select(F.col("key").alias(key), "host", "path", "fit.rule", F.coalesce("fit.verdict", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")
