"""Personal data by weak supervision, in DataFrame expressions only.

Base patterns give spans that always stay. Wider patterns (national phone numbers, spelled
out addresses, social security numbers, keys and passwords) give candidates. Labelers vote
on every span, base matches that failed their test included: the structure of the match, a
gazetteer, the words around it, and its borders. Expectation-maximisation over the counts
of vote patterns estimates each labeler's reliability; its posteriors train a logistic span
classifier, which alone decides on the candidates.

The candidates of a document stay in one array beside its id, so nothing is shuffled but
the counts of vote patterns.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, col

#: Kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
#: Each finds the leftmost non-overlapping matches of the plain pattern named beside it, without
#: retrying inside a run that failed and without recursion, so long runs cost linear time.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits: these matches are the maximal chains
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of candidates: the kind, and the pattern.
WIDER = (
    ("phone", r"(?<![0-9+(.\x20-])(?:(?<![0-9])|\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ssn", r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])"),
    # a run of 16 characters or more with a digit and a letter among them
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+"),
)
#: Fixed values of the gazetteer labeler.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|br|mx|jp|cn|in|au"
CALLING = r"^\+(?:1|7|2[07]|3[0-46-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: How keys of well-known services begin, and forms of long names that are no keys.
KEY_STARTS = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|glpat-|xox[abp]-|sk_live_|sk-|eyJ)"
NO_KEY = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^(?:[A-Za-z]+|[0-9]{1,6})(?:[-_/+]+(?:[A-Za-z]+|[0-9]{1,6}))+[-_/+]*$|^[0-9-]+[a-z]+$"
#: Fixed values of the context labeler: words before a span that speak for it, and against it; for secrets, the name that a value is assigned to.
SPEAKS_FOR = r"(?i)\b(?:e-?mail|mail|contact|kontakt|courriel|correo|phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|mobile|cell|fax|card|karte|carte|tarjeta|visa|mastercard|ip|host|address|ssn|social security)\b"
SPEAKS_AGAINST = r"(?i)\b(?:version|release|build|isbn|issn|doi|order|invoice|serial|model|sku|section|chapter|license|token|hash|commit|rfc)\b"
SECRET_FOR = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer|credentials?)[\"']?\s*[=:]?\s*[\"']?$"
SECRET_AGAINST = r"(?i)(?:commit|sha(?:1|256)?|md5|checksum|digest|etag|uuid|revision|isbn|doi|version|path|file|href|url)[\"']?\s*[=:]?\s*[\"']?$"
#: Characters before a span that the context labeler reads.
CONTEXT = 40
LABELERS = ("structure", "gazetteer", "context", "border")
#: A candidate is added if the classifier gives it this probability or more.
ADD_AT = 0.8
#: Running sums over the matches of a text go over blocks of so many, then inside each.
BLOCK = 64
EM_ROUNDS = 10


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    back = F.reverse(number)
    at = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def sound(kind: str, m: Column) -> Column:
    """The test that a match of a kind has to pass."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return F.size(F.array_distinct(F.split(m, ""))) >= 8
    return F.lit(True)


def listed(kind: str, m: Column) -> Column:
    """The gazetteer's vote: 1, 0, or -1 for none."""
    if kind == "email":
        return m.rlike(rf"(?i)[.\]) ](?:{TOP_DOMAINS})$").cast("int")
    if kind == "ip":
        return F.when(m.rlike(r"^(?:0|127|255|22[4-9]|2[34][0-9])\."), 0).otherwise(-1)
    if kind == "card":
        return m.rlike("^[3-6]").cast("int")
    if kind == "phone":
        return F.when(m.startswith("+"), m.rlike(CALLING).cast("int")).otherwise(-1)
    if kind == "secret":
        return F.when(m.rlike(KEY_STARTS), 1).when(m.rlike(NO_KEY), 0).otherwise(-1)
    return F.lit(-1)


def found(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Array of the spans of a pattern: kind, start, end in code points, base, votes.

    Pieces between matches and the matches in turn make up the text, so their lengths give
    the starts.
    """
    def starts(matches: Column, pieces: Column) -> Column:
        """The sums of the lengths before each match."""
        sizes = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.length(m) + F.length(p))
        total = lambda a: F.aggregate(a, F.lit(0), lambda acc, n: acc + n)

        def of(x: Column) -> Column:
            # an array of one binds the sizes, which are then found once
            none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
            step = lambda acc, b: F.struct((acc["at"] + total(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
            blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), none, step)["starts"]
            inside = lambda b, i: b + total(F.slice(x, i - i % BLOCK + 1, i % BLOCK))
            each = F.transform(F.array(blocks), lambda bs: F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: inside(F.get(bs, F.floor(i / BLOCK).cast("int")), i)))
            return F.when(F.size(x) > 0, F.get(each, F.lit(0))).otherwise(none["starts"])

        before = F.get(F.transform(F.array(sizes), of), F.lit(0))
        return F.zip_with(before, F.slice(pieces, 1, F.size(matches)), lambda at, p: at + F.length(p))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))

    def span(m: Column, start: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(start, F.lit(CONTEXT)))
        after = F.substring(text, start + F.length(m) + 1, F.lit(1))
        against, speaks_for = (SECRET_AGAINST, SECRET_FOR) if kind == "secret" else (SPEAKS_AGAINST, SPEAKS_FOR)
        context = F.when(before.rlike(against), 0).when(before.rlike(speaks_for), 1).otherwise(-1)
        border = F.when(before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]"), 0).otherwise(1)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), F.lit(base).alias("base"),
            sound(kind, m).cast("int").alias("structure"), listed(kind, m).cast("int").alias("gazetteer"), context.cast("int").alias("context"), border.cast("int").alias("border"),
        )

    # an array of one binds the matches and pieces, which are then found once
    pairs = F.transform(F.array(both), lambda z: F.zip_with(z["matches"], starts(z["matches"], z["pieces"]), lambda m, start: F.struct(m.alias("m"), start.alias("start"))))
    return F.transform(F.get(pairs, F.lit(0)), lambda x: span(x["m"], x["start"]))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, spans: every match with its votes, base ones first, in the order of kinds and starts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    # a pattern runs only over texts that hold a character it needs
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint, base: boolean, structure: int, gazetteer: int, context: int, border: int>>")
    parts = [F.when(needs[k], found(text, k, p, True)).otherwise(none) for k, p in PATTERNS.items()]
    first = {"email": r"[\[(]at[\])]", "secret": WIDER[-1][1]}
    parts += [F.when(text.rlike(first.get(k, r"[0-9]{4}")), found(text, k, p, False)).otherwise(none) for k, p in WIDER]
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


def reliabilities(votes: DataFrame) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior, and of each labeler the odds of a vote 1 given a true and a false span (Dawid and Skene's estimate).

    `votes` has a row for each pattern of votes with its count n: its size is bounded by
    three to the number of labelers, times the kinds.
    """
    prior, rates = 0.5, {name: (0.8, 0.3) for name in LABELERS}
    for _ in range(EM_ROUNDS):
        p = votes.withColumn("p", posterior(prior, rates))
        sums = [F.sum(F.col("n") * F.col("p")).alias("true"), F.sum("n").alias("all")]
        for name in LABELERS:
            voted = F.col(name) >= 0
            sums += [F.sum(F.when(voted & cond, F.col("n") * q)).alias(f"{name}_{tag}") for tag, q, cond in (("t", F.col("p"), F.lit(True)), ("f", 1 - F.col("p"), F.lit(True)), ("t1", F.col("p"), F.col(name) == 1), ("f1", 1 - F.col("p"), F.col(name) == 1))]
        got = {k: float(v or 0) for k, v in p.agg(*sums).first().asDict().items()}
        prior = (got["true"] + 1) / (got["all"] + 2)
        rates = {name: ((got[f"{name}_t1"] + 2) / (got[f"{name}_t"] + 3), (got[f"{name}_f1"] + 1) / (got[f"{name}_f"] + 3)) for name in LABELERS}
    return prior, rates


def posterior(prior: float, rates: dict[str, tuple[float, float]], of=F.col) -> Column:
    true, false = F.lit(prior), F.lit(1 - prior)
    for name, (t, f) in rates.items():
        vote = of(name)
        true = true * F.when(vote == 1, t).when(vote == 0, 1 - t).otherwise(1.0)
        false = false * F.when(vote == 1, f).when(vote == 0, 1 - f).otherwise(1.0)
    return true / (true + false)


def features(of) -> list[Column]:
    """Numbers that the classifier reads: each labeler's two votes and the kind."""
    return [(of(name) == v).cast("double") for name in LABELERS for v in (1, 0)] + [(of("kind") == k).cast("double") for k in range(len(KINDS))]


def classifier(votes: DataFrame) -> tuple[float, list[float]]:
    """Intercept and weights of the span classifier, fitted to the posteriors; zeros without spans."""
    prior, rates = reliabilities(votes)
    p = posterior(prior, rates)
    rows = votes.select(array_to_vector(F.array(*features(F.col))).alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * p).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - p)).alias("weight")))).alias("x"))
    model = LogisticRegression(maxIter=15, regParam=1e-3, weightCol="weight").fit(rows.select("features", "x.label", "x.weight").where("weight > 0"))
    return float(model.intercept), [float(c) for c in model.coefficients]


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start, end in code points, in the order of KINDS and starts).

    Null and empty texts have no spans; a table without any span has none to learn from and
    adds none. Repeated rows are judged alike; extra columns are ignored; no rows, no result.
    """
    scratch = Scratch(docs.sparkSession, "personal")
    found_ = scratch.save(candidates(docs, id_col, text_col), "candidates")
    votes = scratch.save(found_.select(F.explode("spans").alias("s")).groupBy("s.kind", *(f"s.{n}" for n in LABELERS)).agg(F.count("*").alias("n")), "votes")
    base = F.filter("spans", lambda s: s["base"] & (s["structure"] == 1))
    if votes.limit(1).count():
        intercept, weights = classifier(votes)
    else:
        intercept, weights = -99.0, []
    ids = F.lit(0.0)
    add = lambda s: ~s["base"] & (1 / (1 + F.exp(-(sum((x * w for x, w in zip(features(lambda n: s[n]), weights, strict=False)), ids) + intercept))) >= ADD_AT)
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return (
        found_.withColumn("base", plain(base))
        .withColumn("added", F.filter("spans", lambda s: add(s) & clear(s)))
        .select("doc_id", "base", F.when(F.size("added") == 0, F.col("base")).otherwise(F.array_sort(F.array_distinct(F.concat("base", plain(F.col("added")))))).alias("spans"))
    )


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found_: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_spans (all of them)."""
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found_.select("doc_id", *counts, F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[PII]") -> DataFrame:
    """doc_id, text with every span replaced by `mask`; rows of one id are told apart by nothing, so ids should be unique here."""
    spans = detected(docs, id_col, text_col).select(F.col("doc_id"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("cuts"))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")).join(spans, "doc_id")
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.expr("''"), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask)).alias("out"), s["end"].alias("at")))
    done = F.aggregate("cuts", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step)
    return rows.withColumn("d", done).select("doc_id", F.concat(F.col("d.out"), F.substring(F.col("text"), (F.col("d.at") + 1).cast("int"), F.length("text"))).alias("text"))
