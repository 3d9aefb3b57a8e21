"""Personal data by weak supervision.

Strict patterns give base spans, which always stay. Looser patterns (CANDIDATES) give candidates, on which labelers
vote yes, no or abstain: a format regex, a gazetteer, trigger words before the span, counter-words before it, and the
span's shape. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, without
labelled text, and the probability of every pattern. These soft labels train a span classifier, which decides: naive
Bayes over the votes, as weighed by their reliability, the word before, the span's length and the character after it.

Everything per row is native, and linear but for one sort of spans. The corpus enters the model as two aggregates of fixed size: at most 6 * 3^5 vote
patterns and 6 * 69 feature values, whatever the table's size. The scan leaves only spans; there is no join. Texts are
scanned once, by mask() too, which writes the rows with their spans before it trains.

Defined cases: a null text is empty; texts are scanned whole; candidates that neither the gazetteer nor a trigger word backs, nor two other labelers, nor a name's title, are
never accepted; of a run of capitalised words each pair of neighbours is judged; candidates that overlap a base span are dropped; of spans that tie for a place the kind listed first comes first;
where spans overlap, the first one's kind stands for all; repeated rows count each; an empty table trains an
empty model; other columns are not read by find() and pass through mask() whatever they are called.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written
from .spans import clear_of, let, matches, replaced

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Sr|Sra|Señor|Señora"
WORD = "[A-Z][a-zà-ÿ]{1,20}"
#: Candidates: kind and pattern ("digits" are runs like a card's that fail its check). Names have two: leftmost pairs of capitalised words, and the pairs between these, so that each pair of neighbours in a run is one.
CANDIDATES = (
    ("name", rf"(?=[A-Z])(?<![\p{{L}}])(?:(?:{TITLES})\.? )?{WORD} {WORD}(?![\p{{L}}])"),
    ("name", rf"(?=[A-Z])(?<= )(?<=(?<![\p{{L}}]){WORD} )(?<!(?<![\p{{L}}])(?:{TITLES}) ){WORD} {WORD}(?![\p{{L}}])"),
    ("idnum", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("local", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"),
    ("hidden", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,10}(?![A-Za-z])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("digits", ""),
)
KINDS = (*BASE, *dict.fromkeys(k for k, _ in CANDIDATES))
#: Gazetteers and trigger words.
FIRST_NAMES = (
    "Adam Agnes Alain Albert Alex Alexander Alice Alicia Amanda Amy Ana Andre Andrea Andreas Andrew Angela Anita Ann Anna Anne Antoine Antonio Arthur Barbara Beatriz Ben Benjamin Bernard "
    "Bernd Brian Bruno Camille Carl Carlos Carmen Carol Caroline Catherine Cecile Charles Charlotte Chloe Chris Christian Christine Christoph Claire Clara Claude Claudia Cristina Daniel "
    "David Deborah Diana Diego Dieter Dominique Donna Eduardo Edward Elena Elisabeth Elizabeth Emily Emma Eric Erik Eva Felix Fernando Florian Francisco Francois Frank Franz Fred Gabriel "
    "Georg George Gerard Grace Guillaume Hans Heinz Helen Helga Henry Hugo Ines Ingrid Irene Isabel Jack Jacques James Jan Jane Javier Jean Jennifer Jessica Joan Johann John Jonas Jorge Jose "
    "Joseph Juan Julia Julie Karen Karin Karl Kevin Klaus Laura Lea Linda Lisa Louis Lucas Lucia Luis Manuel Marc Marco Maria Marie Mark Markus Marta Martin Mary Matthew Max Michael Michel "
    "Miguel Monica Nicole Nina Olivier Oscar Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Rafael Raul Richard Robert Sara Sarah Simon Sofia Sophie Stefan Susan Thomas Ursula Victor William"
).split()
NO_NAMES = "Dear Hello Hi Hallo Liebe Lieber Cher Chère Querido Querida Contact Signed From Name Author By Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame The This That These Those And But For With From Of On In To Is Are Was It As At By Or An Der Die Das Und Le La Les Et Un Une El Los Las Que De Del Version License General Public Creative Commons Apache".split()
DOMAINS = "com net org edu gov io de fr es uk info eu".split()
COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV "
    "MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
).split()
TRIGGERS = {
    "name": r"(?i:name|contact|signed|from|dear|mr|mrs|ms|dr|author|by)[:.,]?\s*$",
    "idnum": r"(?i:ssn|social security|tax id|id(?: no\.?| number)?)[:#]?\s*$",
    "local": r"(?i:tel|phone|call|fax|mobile|cell|telefon|teléfono|téléphone)[.:]?\s*$",
    "hidden": r"(?i:e-?mail|mail|contact|write|reach)(?: (?:me|us|to|at|on|via))*[:]?\s*$",
    "iban": r"(?i:iban|account|konto|cuenta|compte)(?: no\.?)?[:]?\s*$",
    "digits": r"(?i:card|visa|mastercard|amex|credit|karte|carte|tarjeta)(?: no\.?| number)?[:#]?\s*$",
}
AGAINST = r"(?i:version|page|pages|isbn|issn|order|invoice|serial|part|vol|fig|section|no)[.:#]?\s*$|[$€£§#%=]\s*$"
LABELERS = ("format", "gazetteer", "trigger", "against", "shape")
#: Where expectation-maximisation starts, by labeler: (no, abstain, yes) for harmless and for personal spans.
START = (
    ((0.25, 0.7, 0.05), (0.03, 0.67, 0.3)),
    ((0.2, 0.78, 0.02), (0.03, 0.47, 0.5)),
    ((0.001, 0.969, 0.03), (0.001, 0.599, 0.4)),
    ((0.2, 0.799, 0.001), (0.02, 0.979, 0.001)),
    ((0.1, 0.899, 0.001), (0.01, 0.989, 0.001)),
)
#: START counts as so many spans at least, and as this share of a kind's spans, so that a kind whose spans all look alike is judged by it.
ANCHOR, ANCHOR_SHARE = 10, 0.25
#: A labeler takes harmless spans for personal at most so many times as often as START has it: without that, estimation could hold a kind with many votes for all harmless.
MOST_FALSE = 2
ROUNDS = 60
#: A span needs a yes of the gazetteer or of a trigger word, or two; a name's title is enough.
BACKED = "^-?[01],1|^-?[01],-?[01],1|1,.*(?<!-)1"
BUCKETS = 32
SMOOTH = 8.0


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check that doubles every second one from the right."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def checked(iban: Column) -> Column:
    """Whether an account number is 1 modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.regexp_replace(iban, " ", "")
    digit = lambda a, c: (a * F.when(c >= 65, 100).otherwise(10) + F.when(c >= 65, c - 55).otherwise(c - 48)) % 97
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), F.ascii), F.lit(0), digit) == 1


def base_spans(text: Column) -> Column:
    """struct of the base kinds' spans, and of card-like runs that fail the check."""
    card = let(
        F.filter(matches(text, CARD), lambda s: F.length(digits(s["text"])).between(13, 19)),
        lambda c: F.struct(F.filter(c, lambda s: luhn(digits(s["text"]))).alias("good"), F.filter(c, lambda s: ~luhn(digits(s["text"]))).alias("bad")),
    )
    ip = F.filter(matches(text, IP), lambda s: ~F.exists(F.split(s["text"], r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")))
    phone = F.filter(matches(text, PHONE), lambda s: F.length(digits(s["text"])).between(9, 15))
    return let(card, lambda c: F.struct(matches(text, EMAIL).alias("email"), ip.alias("ip"), c["good"].alias("card"), phone.alias("phone"), c["bad"].alias("digits")))


def _kinded(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _among(x: Column, words: list[str]) -> Column:
    return x.isin(words)


def _votes(kind: str, s: Column, before: Column) -> list[Column]:
    """One vote a labeler: 1 yes, 0 abstain, -1 no."""
    t = s["text"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    titled = t.rlike(r"^(?:" + TITLES + r")\.? ")
    words = F.split(F.regexp_replace(t, r"^(?:" + TITLES + r")\.? ", ""), " ")
    form = {
        "name": vote(titled, never),
        "idnum": vote(t.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), t.rlike("^(?:000|666)|-00-|-0000$")),
        "local": vote(t.rlike(r"^\([2-9]|^[2-9][0-9]{2}([ .-])[0-9]{3}\1"), t.rlike(r"^\(?[01]")),
        "hidden": vote(t.rlike(r"\[at\]|\(at\)"), never),
        "iban": vote(F.length(F.regexp_replace(t, " ", "")).between(15, 34) & checked(t), ~checked(t)),
        "digits": vote(never, F.lit(True)),
    }[kind]
    gazetteer = {
        "name": vote(_among(F.get(words, F.lit(0)), FIRST_NAMES), F.exists(words, lambda w: _among(w, NO_NAMES))),
        "idnum": F.lit(0),
        "local": vote(never, t.rlike("555[ .-]01")),
        "hidden": vote(F.lower(F.regexp_extract(t, "([A-Za-z]+)$", 1)).isin(DOMAINS), F.lit(True)),
        "iban": vote(F.substring(t, 1, 2).isin(COUNTRIES), F.lit(True)),
        "digits": vote(never, t.rlike("^(?:4|5[1-5]|3[47]|6011)")),
    }[kind]
    shape = vote(never, t.rlike(r"(.)\1{4}|0123456|1234567"))
    return [form, gazetteer, vote(before.rlike(TRIGGERS[kind]), never), vote(never, before.rlike(AGAINST)), shape]


def _judged(spans: Column, kind: str) -> Column:
    """Candidates with their votes, joined to a pattern like 1,0,0,-1,0, and their other features."""

    def one(s: Column) -> Column:
        before, after = s["before"], s["after"]
        word = F.lower(F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("rank"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.array_join(F.array(*[v.cast("string") for v in _votes(kind, s, before)]), ",").alias("votes"),
            F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int").alias("word"),
            F.least(s["end"] - s["start"], F.lit(31)).cast("int").alias("size"),
            F.when(after.rlike(r"[\p{L}]"), 0).when(after.rlike("[0-9]"), 1).when(after.rlike(r"[.,;:!?)]"), 2).when(after == "", 3).otherwise(4).alias("next"),
        )

    return F.transform(spans, one)


def scanned(text: Column) -> Column:
    """struct of base (array of struct rank, start, end, kind) and of judged candidates."""
    t = F.coalesce(text, F.lit(""))

    def both(b: Column) -> Column:
        base = F.concat(*[_kinded(b[k], k) for k in BASE])
        loose = F.concat(*[_judged(b["digits"] if k == "digits" else matches(t, p), k) for k, p in CANDIDATES])
        return let(F.struct(base.alias("base"), loose.alias("loose")), lambda x: F.struct(x["base"].alias("base"), clear_of(x["loose"], x["base"]).alias("loose")))

    return let(base_spans(t), both)


@dataclass
class Model:
    """Log odds of (kind, feature, value) and of kinds; reliability of each labeler, for those who want to read it."""

    odds: dict[str, float] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, tuple] = field(default_factory=dict)


def expectation_maximisation(counts: dict[tuple[str, str], int]) -> tuple[dict[tuple[str, str], float], dict[str, float], dict[str, list]]:
    """Probability of each (kind, pattern), prior of each kind, and by kind and labeler the chances of its votes for either class.

    Kinds are estimated apart, as a frequent one would else set the chances of all. A labeler may turn out to know nothing,
    but not to mean the opposite: yes is never rarer, and no never more frequent, for personal spans.
    """
    kinds = {k for k, _ in counts}
    chance = {k: [[list(no), list(yes)] for no, yes in START] for k in kinds}
    prior = dict.fromkeys(kinds, 0.3)
    p: dict[tuple[str, str], float] = {}
    for _ in range(ROUNDS if counts else 0):
        for kind, pattern in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for c, v in zip(chance[kind], pattern.split(","), strict=True):
                odds += math.log(c[1][int(v) + 1] / c[0][int(v) + 1])
            p[kind, pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in kinds:
            own = [(key[1].split(","), n, p[key]) for key, n in counts.items() if key[0] == kind]
            anchor = max(ANCHOR, ANCHOR_SHARE * sum(n for _, n, _ in own))
            for i in range(len(LABELERS)):
                sums = [[anchor * x for x in START[i][y]] for y in (0, 1)]
                for votes, n, q in own:
                    v = int(votes[i]) + 1
                    sums[1][v] += n * q
                    sums[0][v] += n * (1 - q)
                chance[kind][i] = directed([[x / sum(s) for x in s] for s in sums], MOST_FALSE * START[i][0][2])
            prior[kind] = min(0.95, max(0.05, (3 + sum(n * q for _, n, q in own)) / (10 + sum(n for _, n, _ in own))))
    return p, prior, chance


def directed(chance: list[list[float]], most: float = 1.0) -> list[list[float]]:
    """Chances of (no, abstain, yes) for harmless and personal spans, pooled where a vote would mean its opposite; harmless ones get no more than `most` yes."""
    no, yes = [chance[0][0], chance[1][0]], [min(most, chance[0][2]), chance[1][2]]
    if no[1] > no[0]:
        no = [sum(no) / 2] * 2
    if yes[1] < yes[0]:
        yes = [sum(yes) / 2] * 2
    return [[no[y], max(1e-6, 1 - no[y] - yes[y]), yes[y]] for y in (0, 1)]


def _feature_keys(c: Column) -> Column:
    votes = F.transform(F.split(c["votes"], ","), lambda v, i: F.concat_ws("|", c["kind"], i.cast("string"), v))
    return F.concat(votes, _other_keys(c))


def _other_keys(c: Column) -> Column:
    return F.array(*[F.concat_ws("|", c["kind"], F.lit(n), c[n].cast("string")) for n in ("word", "size", "next")])


def _map(values: dict[str, float]) -> Column:
    keys = sorted(values)
    if not keys:
        return F.create_map().cast("map<string,double>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(float(values[k])) for k in keys]))


def train(found: DataFrame, loose: str = "loose") -> Model:
    """The classifier for a table with a column of judged candidates."""
    each = found.filter(F.size(loose) > 0).select(F.explode(loose).alias("c"))
    counts = {(r[0], r[1]): r[2] for r in each.groupBy("c.kind", "c.votes").count().collect()}
    if not counts:
        return Model()
    p, prior, chance = expectation_maximisation(counts)
    sure = _map({f"{k}|{v}": x for (k, v), x in p.items()})
    keyed = each.select(F.try_element_at(sure, F.concat_ws("|", "c.kind", "c.votes")).alias("p"), F.explode(_other_keys(F.col("c"))).alias("f"))
    seen = {r[0]: (r[1], r[2]) for r in keyed.groupBy("f").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()}
    odds = {f"{k}|{i}|{v - 1}": math.log(c[1][v] / c[0][v]) for k in chance for i, c in enumerate(chance[k]) for v in range(3)}
    for f, (yes, no) in seen.items():
        own = [(n, p[key]) for key, n in counts.items() if key[0] == f.split("|", 1)[0]]
        a, b = sum(n * q for n, q in own), sum(n * (1 - q) for n, q in own)
        rate = SMOOTH * (yes + no) / (a + b)
        odds[f] = math.log((yes + rate) / (a + SMOOTH)) - math.log((no + rate) / (b + SMOOTH))
    return Model(odds, {k: math.log(q / (1 - q)) for k, q in prior.items()}, {f"{k}|{name}": tuple(map(tuple, c)) for k in chance for name, c in zip(LABELERS, chance[k], strict=True)})


def accepted(loose: Column, model: Model) -> Column:
    """The candidates that the classifier takes for personal data, as struct rank, start, end, kind."""
    if not model.odds:
        return F.array().cast("array<struct<rank:int,start:long,end:long,kind:string>>")
    odds, prior = _map(model.odds), _map(model.prior)

    def good(c: Column) -> Column:
        score = F.aggregate(_feature_keys(c), F.coalesce(F.try_element_at(prior, c["kind"]), F.lit(-1.0)), lambda a, f: a + F.coalesce(F.try_element_at(odds, f), F.lit(0.0)))
        return (score > 0) & c["votes"].rlike(BACKED) | (score > 0) & (c["kind"] == "name") & c["votes"].startswith("1")

    return F.transform(F.filter(loose, good), lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and spans of every row: arrays of struct rank, start, end, kind, by kind as listed, then start."""
    rows = written(docs.select(F.col(key).alias("key"), scanned(F.col(text)).alias("s")).select("key", "s.base", "s.loose"), "pii-spans")
    model = train(rows)
    return rows.select(F.col("key").alias(key), "base", F.array_sort(F.concat("base", accepted(F.col("loose"), model))).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, and what overlaps it, replaced by its kind in brackets."""
    return replaced(text, spans, lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data masked in the text; texts without any, and null ones, stay as they are."""
    own = free("_spans", docs)
    rows = written(docs.withColumn(own, scanned(F.col(text))), "pii-rows")
    model = train(rows.select(F.col(f"{own}.loose").alias("loose")))
    found = F.concat(F.col(f"{own}.base"), accepted(F.col(f"{own}.loose"), model))
    return rows.withColumn(text, masked(F.col(text), found)).select(*docs.columns)
