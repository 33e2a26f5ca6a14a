"""Secret scan: candidates judged by a random forest, in DataFrame operations only.

Candidates are runs of at least ``MIN_LENGTH`` characters of the alphabets that keys are written
in, with a digit in them; values of ``MIN_VALUE`` and more visible characters assigned to a
credential word, quoted or not (inside quotes with blanks too); and whole private key blocks. The forest sees its length, the character classes and the transitions
between them, the share of it that dictionary words cover, its path (the document's source and
the place in the text), and the neighbouring words. It is trained on labelled findings and
removes false positives: numbers, addresses and identifiers that look like keys.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import text_key, text_or_empty
from matrel.session import stage

MIN_LENGTH = 16
RUN = "A-Za-z0-9_+/=-"
CANDIDATE = rf"(?<![{RUN}])(?=[A-Za-z_+/=-]*[0-9])[{RUN}]{{{MIN_LENGTH},}}"
MIN_VALUE = 6
#: A key block of any length: its body has no row of five dashes.
MARKED = r"-----{} [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----"
BLOCK = MARKED.format("BEGIN") + r"[^-]*+(?:-(?!----)[^-]*+)*+" + MARKED.format("END")
WORDS = "(?:token|secret|passw|passphrase|pwd|api.?key|access|auth|bearer|credential|private)"
NAMED = rf"""(?i:{WORDS})[\w.-]{{0,40}}["'`\]]{{0,2}}[ \t]{{0,4}}(?::=|=>|[=:])[ \t]{{0,4}}"""
QUOTED = "|".join(rf"{q}[^{q}\r\n]{{{MIN_VALUE},}}+{q}" for q in "\"'`")
BARE = rf"""[^\s"'`]\S{{{MIN_VALUE - 2},}}[^\s,;)\]}}>"'`]"""
#: A key block, or a credential word with its value.
ASSIGNED = rf"{BLOCK}|{NAMED}(?:{QUOTED}|{BARE})"
SPACE = r"[ \t\n\r\x0b\f]+"
KEYWORDS = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access|auth|bearer|credential|private)"
#: A word seen at least once in this many words is in the dictionary, which holds no more words than that.
DICTIONARY = 20_000
#: Bound of the labelled findings that the forest is fitted on.
LABELLED = 20_000
TREES, DEPTH, SEED = 24, 6, 11
MARK = "[SECRET]"

FEATURES = ["length", "digits", "lowers", "uppers", "marks", "transitions", "distinct", "coverage", "path", "place",
            "assigned", "quoted", "keyword", "neighbour_words", "neighbour_digits"]


def dictionary(docs: DataFrame, bound: int = DICTIONARY) -> DataFrame:
    """Frequent words of three or more letters, ``word``; at most ``bound`` of them."""
    words = docs.select(F.explode(F.split(F.lower(text_or_empty()), r"[^\p{L}]+")).alias("word")).filter("length(word) >= 3")
    counts = stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.filter(F.col("n") * bound >= total).select("word")


def findings(docs: DataFrame) -> DataFrame:
    """Candidates with their neighbours: ``doc_id, text_key, source, place, n_words, before, word, after, secret``.

    ``place`` is the number of the word that holds the candidate; repeated rows are found once.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_key().alias("text_key"), text_or_empty().alias("t"))
    words = F.split("t", SPACE)
    both = F.col("t").rlike(CANDIDATE) | F.col("t").rlike(ASSIGNED)
    rows = rows.filter(both).withColumn("words", words).withColumn("n_words", F.size("words"))
    at = lambda i: F.try_element_at(F.col("words"), i)
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct((i + 1).alias("place"), w.alias("word"))), lambda x: x["word"].rlike(CANDIDATE))
    runs = F.flatten(F.transform(hits, lambda x: F.transform(
        F.regexp_extract_all(x["word"], F.lit(CANDIDATE), F.lit(0)), lambda r: F.struct(x["place"].alias("place"), r.alias("secret")))))
    rows = rows.select("*", F.explode(F.array_distinct(F.concat(runs, _assigned()))).alias("hit"))
    place = F.col("hit.place")
    before = F.array_join(F.slice("words", F.greatest(place - 3, F.lit(1)), F.least(place - 1, F.lit(3))), " ")
    rows = rows.select("doc_id", "text_key", "source", place.alias("place"), "n_words", before.alias("before"),
                       at(place).alias("word"), F.coalesce(at(place + 1), F.lit("")).alias("after"), F.col("hit.secret").alias("secret"))
    return rows.distinct()


def _assigned() -> Column:
    """Key blocks and assigned values of ``t`` as ``array<struct<place, secret>>``, found before the text is split into words."""
    found = F.regexp_extract_all("t", F.lit(ASSIGNED), F.lit(0))
    between = F.split("t", ASSIGNED, -1)                     # the text before each match, and after the last one
    blanks = lambda x: F.size(F.split(x, SPACE, -1)) - 1     # runs of white space; none lies across the ends of a match
    value = lambda m: F.when(m.rlike(rf"\A{BLOCK}"), m).otherwise(F.regexp_replace(m, rf"\A{NAMED}", ""))
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(
        m.alias("match"), value(m).alias("raw"), blanks(gap).alias("gap"), blanks(m).alias("inside")))
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("before"))
    counted = F.aggregate(steps, start, lambda done, x: F.struct(
        (done["seen"] + x["gap"] + x["inside"]).alias("seen"), F.concat(done["before"], F.array(done["seen"] + x["gap"])).alias("before")),
        lambda done: done["before"])

    def finding(x: Column, before: Column) -> Column:
        raw = x["raw"]
        name = F.substring(x["match"], F.lit(1), F.length(x["match"]) - F.length(raw))
        bare = F.when(raw.rlike("\\A[\"'`]"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.struct((before + blanks(name) + 1).alias("place"), bare.alias("secret"))

    return F.zip_with(steps, counted, finding)


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("secret", pattern, "")) / F.length("secret")


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The findings with the columns of ``FEATURES``; ``words`` is a dictionary of bounded size."""
    length = F.length("secret").cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("secret", "[^A-Za-z0-9]", "_"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    spelled = found.select("secret").distinct().withColumn("word", F.explode(F.split(F.lower("secret"), "[^a-z]+"))).filter("length(word) >= 3")
    covered = spelled.join(F.broadcast(words), "word", "left_semi").groupBy("secret").agg(F.sum(F.length("word")).alias("covered"))
    rows = found.join(covered, "secret", "left")
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    around = F.concat_ws(" ", "before", "after")
    return rows.select(
        *found.columns, length.alias("length"), _share("[^0-9]").alias("digits"), _share("[^a-z]").alias("lowers"),
        _share("[^A-Z]").alias("uppers"), _share("[A-Za-z0-9]").alias("marks"), (runs / length).alias("transitions"),
        (F.size(F.array_distinct(F.split("secret", ""))) / length).alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / length).alias("coverage"),
        F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(32)).cast("double").alias("path"),
        (F.col("place") / F.col("n_words")).alias("place_share"),
        one(F.col("before").rlike("[=:]$") | F.col("word").rlike("[A-Za-z][=:]")).alias("assigned"),
        one(F.col("word").rlike("[\"'`]")).alias("quoted"), one(F.concat_ws(" ", "before", "word").rlike(KEYWORDS)).alias("keyword"),
        F.pmod(F.xxhash64(F.lower(F.substring_index("before", " ", -1))), F.lit(64)).cast("double").alias("neighbour_words"),
        (F.length(F.regexp_replace(around, "[^0-9]", "")) / F.greatest(F.length(around), F.lit(1))).alias("neighbour_digits"))


def label_findings(found: DataFrame) -> DataFrame:
    """Weak labels where a rule is sure: ``label`` 1.0 or 0.0, null elsewhere.

    A private key block is a secret, and so is a quoted value assigned to a credential name unless
    it is a placeholder; numbers, parts of addresses and links, and unquoted words of the dictionary
    are not.
    """
    block = F.col("secret").rlike(rf"\A{BLOCK}")
    quoted = F.col("word").rlike("[\"'`]")
    letters = F.regexp_replace("secret", "[^A-Za-z]", "")
    spelled = ~quoted & F.col("secret").rlike(r"^[A-Z]?[a-z]+[.:!?]?$") & (F.round(F.col("coverage") * F.col("length")) == F.length(letters))
    placeholder = F.col("secret").rlike(r"(?i)(example|changeme|placeholder|your|xxxx|12345678|(.)\2{5})")
    sure = F.concat_ws(" ", "before", "word").rlike(KEYWORDS + r"\S*\s*[=:]") & F.col("word").rlike("[\"']")
    # a sign @ inside a quoted credential makes no address of it
    address = F.col("word").contains("@") & (~sure | F.col("secret").rlike(r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$"))
    harmless = F.col("secret").rlike("^[0-9]+$") | address | F.col("word").rlike(r"://|www\.") | placeholder | spelled
    return found.withColumn("label", F.when(block, 1.0).when(harmless, 0.0).when(sure, 1.0))


def train_forest(labelled: DataFrame, bound: int = LABELLED) -> RandomForestClassificationModel | float | None:
    """A forest from findings with features and a ``label``; at most ``bound`` / 2 rows of each label, chosen by hash, are used.

    Both labels weigh the same in sum. With labels of one class only, that label; without labels, None.
    """
    order = [F.xxhash64("secret", "before", "after"), "secret", "doc_id", "text_key", "place"]
    sample = lambda label: stage(labelled.filter(F.col("label") == label).orderBy(*order).limit(bound // 2).select(*_INPUTS, "label").coalesce(1))
    parts = {label: sample(label) for label in (0.0, 1.0)}
    counts = {label: n for label, part in parts.items() if (n := part.count())}
    if len(counts) < 2:
        return next(iter(counts), None)
    rows = [parts[label].withColumn("weight", F.lit(sum(counts.values()) / (2 * n))) for label, n in counts.items()]
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="inputs", labelCol="label", weightCol="weight")
    return forest.fit(_vectors(rows[0].unionByName(rows[1]).coalesce(1)))


_INPUTS = [f if f != "place" else "place_share" for f in FEATURES]


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=_INPUTS, outputCol="inputs", handleInvalid="keep").transform(rows)


def score_findings(rows: DataFrame, model: RandomForestClassificationModel | float | None) -> DataFrame:
    """The findings with ``score``, the probability of a secret.

    Without a forest each finding has its own label by the rules; where they are not sure, the
    only label there is, or 0.
    """
    if isinstance(model, RandomForestClassificationModel):
        scored = model.transform(_vectors(rows))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("inputs", "rawPrediction", "probability", "prediction")
    return label_findings(rows).withColumn("score", F.coalesce("label", F.lit(float(model or 0.0)))).drop("label")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per finding: ``doc_id, place, secret, score, is_secret, text_key``.

    ``labelled`` holds findings with features and labels; without it the findings of ``docs`` are
    labelled by rules. Null texts have no findings, null sources are one path; a row that
    repeats a doc_id and text is reported once. Without labelled findings nothing is a secret.
    An empty table gives an empty result; other columns are ignored.
    """
    found = stage(features(stage(findings(docs)), dictionary(docs)))
    model = train_forest(label_findings(found) if labelled is None else labelled)
    scored = score_findings(found, model)
    return scored.select("doc_id", "place", "secret", "score", (F.col("score") >= 0.5).alias("is_secret"), "text_key")


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All documents with every secret replaced by ``MARK``; all columns stay, ``n_chars`` is counted anew."""
    found = scan(docs, labelled).filter("is_secret").groupBy(F.col("doc_id").alias("__llm_id"), F.col("text_key").alias("__llm_key"))
    # longest first, so a secret inside another one leaves nothing behind
    secrets = stage(found.agg(F.collect_set("secret").alias("__llm_secrets")).withColumn(
        "__llm_secrets", F.array_sort("__llm_secrets", lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).otherwise(1)))))
    names = docs.columns
    rows = docs.withColumn("__llm_own", text_key()).join(
        secrets, F.col("__llm_own").eqNullSafe(F.col("__llm_key")) & F.col("doc_id").eqNullSafe(F.col("__llm_id")), "left")
    text = F.aggregate("__llm_secrets", F.col("text"), lambda done, s: F.replace(done, s, F.lit(MARK)))
    rows = rows.withColumn("text", F.when(F.col("__llm_secrets").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("__llm_secrets").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*names)
