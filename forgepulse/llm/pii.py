"""Operator 8: personal data by candidate gradient boosting, with DataFrame functions and MLlib only.

Generators of high recall propose spans that may overlap: the base patterns (whatever their checks say) and loose
forms.  What passes a base check stays.  Boosted trees, fitted on labelled phrases in which one form stands in telling and in other
contexts, score the loose forms; a threshold for each kind, calibrated on phrases that the trees haven't seen, selects what is
added; of what overlaps one span stays.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import let

#: Base patterns, with \G or a look-behind so that a scan never starts twice in one run, and possessive
#: quantifiers so that no match backs up; the matches are those of the plain patterns, from the left.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: Loose generators: obfuscated addresses, telephone numbers without a country, card numbers in other groupings, account numbers.
LOOSE = (
    ("email_like", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\.)[A-Za-z0-9-]++)++"),
    ("card_like", r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
    ("phone_like", r"(?<![0-9A-Za-z+])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    ("id_like", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
)
KINDS = [k for k, _ in (*BASE, *LOOSE)]
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "[+]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "email_like": r"[\[({]at[\])}]", "card_like": "[0-9]{4}[./_][0-9]{4}", "phone_like": "[0-9]{3}[ .-][0-9]{4}", "id_like": "-[0-9]{2}-"}
CONTEXT = ("mail|contact|write|kontakt|correo|adresse", "phone|telephone|tel|call|fax|mobile|whatsapp", "card|visa|credit|pay|iban|account", "host|server|addr|ping|ip", "ssn|social|passport|id")
#: Words that may stand between a telling word and what it tells of.
BETWEEN = "security|number|no|nr|is|was|me|us|him|her|them|at|on|my|our|the"
#: Labelled phrases: words before a form that make a telephone or account number of it, words that don't, and forms.  A loose address is one anywhere, a card number by its checksum.
TELLING = {"phone_like": ("call", "phone:", "tel.", "fax", "mobile", "whatsapp", "my phone number is", "call me at", "mobile no"), "id_like": ("ssn", "social security number", "passport", "id", "ssn:", "her passport no", "social security number is")}
OTHER = ("part", "order", "invoice", "batch", "serial", "model", "ref", "see", "", "lot number", "item no", "the figure was", "section", "release")
FORMS = {
    "phone_like": ("(212) 555-0187", "415-555-0132", "303 555 0164"), "id_like": ("123-45-6789", "987-65-4321", "301-22-7788"),
    "email_like": ("anna [at] mail [dot] example [dot] org", "bob(at)corp.net", "x.y {at} site {dot} io"),
    "card_like": ("4111.1111.1111.1111", "5500_0000_0000_0004", "4012/8888/8888/1881", "4111.1111.1111.1112", "5500_0000_0000_0014", "4012/8888/8888/1888"),
}
FEATURES = ["length", "digits", "separators", "letters", "dots", "plus", "at", "groups", "checksum", "before_space", "after_space", "kind_number", *(f"context_{i}" for i in range(len(CONTEXT)))]


def _found(text: Column, kind: str, pattern: str) -> Column:
    """The matches of one pattern: what lies between them gives their places, in code points."""
    rows = let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")),
        lambda s: F.transform(s["m"], lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(s["p"], i)).alias("gap"), F.length(m).alias("length"), m.alias("match"), F.right(F.get(s["p"], i), F.lit(24)).alias("before"), F.left(F.get(s["p"], i + 1), F.lit(12)).alias("after"))),
    )
    return F.when(text.rlike(NEEDS[kind]), rows)


OWN = "named_struct('kind', '', 'i', 0, 'gap', 0, 'length', 0, 'match', '', 'before', '', 'after', '')"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_ok(kind: Column, match: Column, digits: Column) -> Column:
    n = F.length(digits)
    small = F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.right(p, F.lit(9)).cast("int") <= 255)
    card = F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", (n >= 9) & (n <= 15)).otherwise(False)


def candidates(df: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, ok (passes a base check) and features; one row of kind '' for each document."""
    text = C.text_col()
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lists = [F.coalesce(_found(F.col("text"), k, p), F.expr(f"array_except(array({OWN}), array({OWN}))")) for k, p in (*BASE, *LOOSE)]
    rows = docs.select("row", "doc_id", F.explode(F.concat(F.expr(f"array({OWN})"), *lists)).alias("c")).select("row", "doc_id", "c.*")
    order = Window.partitionBy("row", "doc_id", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(order).cast("long")).withColumn("start", F.col("end") - F.col("length"))
    rows = rows.withColumn("digit_text", F.regexp_replace("match", "[^0-9]", ""))
    # features are those of the plain form
    plain = F.regexp_replace(F.regexp_replace("match", r"\x20?[\[({]at[\])}]\x20?", "@"), r"\x20?[\[({]dot[\])}]\x20?", ".")
    plain = F.when(F.col("kind") == "card_like", F.regexp_replace(plain, "[./_]", " ")).otherwise(plain)
    count = lambda pattern: F.regexp_count(plain, F.lit(pattern)).cast("double")
    place = {k: float(i) for i, k in enumerate(KINDS)}
    feature = {
        "length": F.length(plain).cast("double"), "checksum": F.when(F.length("digit_text").between(13, 19), luhn(F.col("digit_text"))).otherwise(False).cast("double"), "digits": F.length("digit_text").cast("double"), "separators": count(r"[\x20()-]"), "letters": count("[A-Za-z]"), "dots": count(r"\."), "plus": count(r"\+"), "at": count("@"),
        "groups": count("[0-9A-Za-z]+"), "before_space": F.col("before").rlike(r"(^|\s)$").cast("double"), "after_space": F.col("after").rlike(r"^($|[\s.,;:!?])").cast("double"),
        # a loose form has the number of the kind that it stands for
        "kind_number": F.element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k, place.get(k.removesuffix("_like"), 4.0)))), F.col("kind")),
    } | {f"context_{i}": F.lower("before").rlike(f"(^|[^a-z])({p})(s|ed|ing)?[^a-z]*(({BETWEEN})[^a-z]+)*$").cast("double") for i, p in enumerate(CONTEXT)}
    return rows.select("row", "doc_id", "kind", "start", "end", "match", base_ok(F.col("kind"), F.col("match"), F.col("digit_text")).alias("ok"), *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in feature.items()))


def labelled(spark: SparkSession) -> DataFrame:
    """The phrases as doc_id, text; an odd doc_id is personal data."""
    rows = []
    for kind, forms in FORMS.items():
        told = TELLING.get(kind, ())
        for lead in (*told, *OTHER):
            for k, form in enumerate(forms):
                personal = lead in told or kind == "email_like" or kind == "card_like" and k < 3
                rows.append((2 * len(rows) + personal, f"{lead} {form} now".strip()))
    return spark.createDataFrame(rows, "doc_id long, text string")


def fit(spark: SparkSession, recall: float = 0.9, floor: float = 0.5):
    """(model, thresholds by loose kind): trees from every other labelled phrase.

    A kind's threshold is the score that `recall` of its personal spans among the other phrases reach, `floor` at least.
    """
    found = candidates(labelled(spark)).where(F.col("kind").isin([k for k, _ in LOOSE]))
    rows = found.select((F.col("doc_id") % 2).cast("double").alias("label"), (F.floor(F.col("doc_id") / 2) % 2).alias("fold"), "kind", *FEATURES).coalesce(1).checkpoint()
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=8, maxDepth=4, stepSize=0.3, seed=7, maxBins=32).fit(_vectors(rows.where("fold = 0")))
    low = score(model, rows.where("fold = 1 AND label = 1")).groupBy("kind").agg(F.percentile_approx("score", 1 - recall, 10_000).alias("low"))
    lows = {r["kind"]: r["low"] for r in low.collect()}
    return model, {k: max(floor, lows[k]) for k, _ in LOOSE}


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def score(model, rows: DataFrame) -> DataFrame:
    out = model.transform(_vectors(rows))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def selected(rows: DataFrame) -> DataFrame:
    """Of loose spans (cand) that overlap no base span (ok), the best of each chain of overlapping ones; rows: row, doc_id, kind, start, end, score, ok, cand."""
    doc = Window.partitionBy("row", "doc_id")
    base_end = F.max(F.when(F.col("ok"), F.col("end"))).over(doc.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    base_start = F.min(F.when(F.col("ok"), F.col("start"))).over(doc.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    free = F.col("cand") & (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    rows = rows.withColumn("cand", free)
    order = doc.orderBy("start", "end", "kind")
    reach = F.max(F.when(F.col("cand"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("opens", F.col("cand") & (F.coalesce(reach, F.lit(0)) <= F.col("start")))
    rows = rows.withColumn("chain", F.count_if("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("row", "doc_id", "chain", "cand").orderBy(F.desc("score"), "start", "kind"))
    return rows.withColumn("taken", F.col("ok") | (F.col("cand") & (best == 1)))


def pii_spans(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by kind as listed in KINDS, then start; base spans always stay, loose ones where they
    overlap none of them; of loose spans that overlap one another the best scored stays.  Null and
    empty texts have none; equal rows each get a row; an empty table gives an empty one; other columns are ignored.
    The trees are fitted on the labelled phrases of this module, so a text's spans are the same in every table.
    """
    C.prepare(df.sparkSession)
    model, thresholds = fit(df.sparkSession)
    rows = score(model, candidates(df).select("row", "doc_id", "kind", "start", "end", "ok", *FEATURES))
    add = F.col("score") >= F.element_at(F.create_map(*(F.lit(x) for kt in thresholds.items() for x in kt)), F.col("kind"))
    # a loose card number must pass the card's checksum
    loose = F.col("kind").isin([k for k, _ in LOOSE]) & ((F.col("kind") != "card_like") | (F.col("checksum") == 1))
    rows = selected(rows.select("row", "doc_id", "kind", "start", "end", "ok", "score", F.coalesce(loose & add, F.lit(False)).alias("cand")))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct(place.alias("k"), "start", "end", "kind")))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.count_if(F.col("ok") & (F.col("kind") == kind)).alias(f"n_{kind}")
    out = rows.groupBy("row", "doc_id").agg(*(count(k) for k, _ in BASE), F.sha2(told(F.col("ok")), 256).alias("base_sha256"), told(F.col("taken")).alias("spans"))
    return out.drop("row")
