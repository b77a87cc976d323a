"""Secret scan: candidates by form, and a random forest that tells secrets from look-alikes. Built-in expressions and
Spark's own DataFrame forest alone.

A candidate is a long run of key signs in a word. What the forest sees of it: its length, its signs and the
transitions between kinds of signs, how much of it the corpus has as words (dictionary coverage), the path of the
document, and the neighbouring words. It learns from labelled findings: `generated_findings` writes some by rule (keys of
several kinds, and look-alikes such as digests in lock files, ids in paths, placeholders and long words), and a
table of reviewed findings can be added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.llm.common import free_names, written

MAX_BROADCAST_ROWS = 1_000_000
BREAKS = "[\\x20\\x09-\\x0D]+"
RUN = "[A-Za-z0-9+/_\\-]{16,}={0,2}"
# Words that announce a credential, and parts of paths where look-alikes are common.
KEYWORDS = "(?i)(token|secret|passw|pwd|api_?-?key|apikey|access_?key|private_?key|credential|auth|bearer|signature)"
LOOKALIKE = "(?i)(sha1|sha256|sha512|md5|checksum|digest|integrity|commit|revision|uuid|etag|hash|example|sample)"
DULL_PATH = "(?i)(test|example|sample|mock|fixture|lock|vendor|node_modules|docs?/)"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FEATURES = ["length", "digits", "uppers", "lowers", "signs", "changes", "letter_digit", "case_changes", "distinct", "longest_run",
            "hex", "repeated", "coverage", "keyword", "keyword_near", "lookalike", "assigned", "quoted", "placeholder", "dull_path",
            "after_is_word"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, doc_key, path, pos, candidate, word, before2, before, after): every run of 16 or more key signs.

    Words are what white space of ASCII separates; pos counts them from 0. A word may have several runs. Null text has
    none; a null path is empty. doc_key is a hash of id and text.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    given = docs.select(F.col(id_col).alias("doc_id"), doc_key(id_col, text_col).alias("doc_key"), path.alias("path"),
                        words_of(F.col(text_col)).alias("words"))
    placed = given.select("doc_id", "doc_key", "path", "words", F.posexplode("words").alias("pos", "word"))
    beside = lambda by: F.coalesce(F.when(F.col("pos") + by >= 0, F.get("words", F.greatest(F.lit(0), F.col("pos") + by))), F.lit(""))
    return (placed.where((F.octet_length("word") >= 16) & F.col("word").rlike(RUN))
            .select("doc_id", "doc_key", "path", F.col("pos").cast("long").alias("pos"), F.explode(F.regexp_extract_all("word", F.lit(RUN), 0)).alias("candidate"),
                    "word", beside(-2).alias("before2"), beside(-1).alias("before"), beside(1).alias("after")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BREAKS), "")


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def dictionary(docs: DataFrame, wanted: DataFrame, text_col: str = "text", least: int = 3) -> DataFrame:
    """(part): those of wanted(part) that the corpus has as whole words, lower-case, at least `least` times, over all documents.

    Words are counted where they are read, and only counts are shuffled. Up to MAX_BROADCAST_ROWS wanted ones (some 30
    bytes each) go to where the words are read, so that counts of other words are not even made.
    """
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z]+")).alias("part"))
    words, wanted = words.where(F.length("part") >= 3), wanted.select("part").distinct()
    if wanted.count() <= MAX_BROADCAST_ROWS:
        counts = words.join(F.broadcast(wanted), "part").groupBy("part").count()
    else:
        counts = words.groupBy("part").count().join(wanted, "part")
    return counts.where(F.col("count") >= least).select("part")


def parts_of(candidate: Column) -> Column:
    """Runs of letters of a candidate, lower-case, from three letters on."""
    return F.filter(F.split(F.lower(candidate), "[^a-z]+"), lambda p: F.length(p) >= 3)


def with_coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds coverage: the share of the candidate's length that known(part) covers. Candidates are looked up once each."""
    each = (found.select("candidate").distinct().select("candidate", F.explode(F.array_distinct(parts_of(F.col("candidate")))).alias("part"))
            .join(known, "part").groupBy("candidate").agg(F.collect_set("part").alias("known")))
    covered = F.aggregate(F.filter(parts_of(F.col("candidate")), lambda p: F.array_contains("known", p)), F.lit(0),
                          lambda total, p: total + F.length(p))
    return (found.join(each, "candidate", "left").withColumn("coverage", F.coalesce(covered / F.length("candidate"), F.lit(0.0)))
            .drop("known"))


def _share(candidate: Column, signs: str) -> Column:
    return 1 - F.length(F.translate(candidate, signs, "")) / F.length(candidate)


def featured(found: DataFrame) -> DataFrame:
    """Adds the columns FEATURES to candidates with coverage."""
    c, n = F.col("candidate"), F.length("candidate")
    kinds = F.translate(c, LOWER + UPPER + DIGITS + "+/_-=", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    runs = F.regexp_replace(kinds, "(.)\\1+", "$1")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / n
    announced = F.concat_ws(" ", "before2", "before", F.substring_index("word", "=", 1))
    flag = lambda x: x.cast("double")
    return found.withColumns({
        "length": n.cast("double"), "digits": _share(c, DIGITS), "uppers": _share(c, UPPER), "lowers": _share(c, LOWER),
        "signs": _share(c, "+/_-="), "changes": F.length(runs) / n, "letter_digit": count(runs, "(?<=[aA])0|(?<=0)[aA]"),
        "case_changes": count(runs, "aA|Aa"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "longest_run": F.array_max(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)"), 1), lambda x: F.length(x))) / n,
        "hex": flag(c.rlike("^[0-9a-fA-F-]+$")), "repeated": flag(c.rlike("(.)\\1{4,}")),
        "keyword": flag(announced.rlike(KEYWORDS)), "keyword_near": flag(F.col("after").rlike(KEYWORDS)),
        "lookalike": flag(F.concat_ws(" ", "before2", "before", "word").rlike(LOOKALIKE)),
        "assigned": flag(F.col("before").rlike("[=:]$") | F.col("word").rlike("^[A-Za-z_-]{0,40}[=:]")),
        "quoted": flag(F.col("word").rlike("[\"'`]")), "placeholder": flag(c.rlike("(?i)(x{6,}|your|changeme|placeholder|dummy|12345678)")),
        "dull_path": flag(F.col("path").rlike(DULL_PATH)), "after_is_word": flag(F.col("after").rlike("^[a-z]{2,}[.,;]?$"))})


def generated_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Labelled findings made by rule from row numbers: half are keys of several kinds, half are look-alikes.

    Columns as of `candidates`, and label (1: a secret). The same rows every time. Made in three small written steps, so
    that no expression holds another one many times.
    """
    syllables = ["tion", "er", "the", "an", "ing", "sch", "ment", "que", "lich", "ado", "ble", "wh", "eau"]
    words = ["the", "value", "of", "and", "is", "service", "for", "config", "with", "le", "der", "que", "thanea", "ertion"]
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    drawn = lambda i: F.pmod(F.xxhash64(i, "id"), F.lit(27720)).cast("int")
    some_of = lambda texts, first, n: F.transform(numbers(n), lambda i: F.get(
        F.array(*map(F.lit, texts)), drawn(i + first) % len(texts)))
    raw = written(spark.range(rows).select(
        "id", F.transform(numbers(20), drawn).alias("r"), some_of(syllables, 100, 60).alias("s"), some_of(words, 300, 4).alias("w"),
        F.transform(numbers(8), lambda i: F.sha2(F.concat_ws("/", i.cast("string"), F.col("id").cast("string")), 256)).alias("h"),
        F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "=", "").alias("b")), "findings")

    h = lambda i, n=64: F.substring(F.get("h", F.lit(i)), 1, n)
    text = lambda first, n: F.array_join(F.slice("s", first + 1, n), "")
    pick = lambda i, some: F.get(F.array(*(F.lit(x) if isinstance(x, str) else x for x in some)), F.get("r", F.lit(i)) % len(some))
    uuid = F.concat_ws("-", *(F.substring(h(5), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    made = written(raw.select(
        "id", "r", "w", (F.col("id") % 2 == 0).alias("is_key"),
        pick(0, [h(0, 40), h(1, 32), h(2), F.substring("b", 1, 40), F.substring("b", 1, 24), F.concat(F.lit("AKIA"), F.upper(h(3, 16))),
                 F.concat(F.lit("ghp_"), F.substring("b", 3, 36)), F.concat(F.lit("sk-"), F.substring("b", 2, 32))]).alias("key"),
        pick(1, [h(6, 40), h(7), uuid, F.concat_ws("/", text(0, 3), text(3, 3), text(6, 2)), text(8, 6), text(14, 5), F.lit("x" * 24),
                 F.concat_ws("_", text(19, 2), text(21, 2), text(23, 2)), F.concat(F.lit("YOUR_API_KEY_"), F.upper(text(25, 1))),
                 F.repeat(pick(2, ["-", "=", "_", "a", "0"]), F.lit(20)), text(26, 8)]).alias("other"),
        pick(3, ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "private_key", "signature"]).alias("name"),
        pick(4, ["sha1", "sha256:", "md5", "checksum", "commit", "integrity", "digest:", "revision"]).alias("dull"),
        pick(5, ["", "", "", "src/app.py", "config/settings.yml", "package-lock.json", "tests/fixtures/a.json", "README"]).alias("path")), "findings")

    # Signs of a digest are a look-alike only next to a word that says so, and a secret only next to a keyword. A third of the
    # other keys stand in plain words, and a quarter of the look-alikes that are no digest or uuid come with a keyword.
    digest = ~F.col("is_key") & F.col("other").rlike("^[0-9a-f]{40,}$")
    word = lambda i: F.get("w", F.lit(i))
    bare = F.col("is_key") & ~F.col("key").rlike("^[0-9a-f]+$") & (F.get("r", F.lit(9)) % 3 == 0)
    told = ~F.col("is_key") & ~F.col("other").rlike("^[0-9a-f-]{32,}$") & (F.get("r", F.lit(10)) % 4 == 0)
    before = F.when(bare, word(0)).when(told, pick(11, [F.concat("name", F.lit(":")), F.concat("name", F.lit("=")), F.col("name")])
                                        ).when(F.col("is_key"), pick(6, ["=", ":", "=", F.concat("name", F.lit(":")), F.concat("name", F.lit("=")), F.col("name")])
                    ).when(digest, F.col("dull")).otherwise(word(0))
    written_as = F.when(F.col("is_key"), pick(7, [F.concat(F.lit('"'), "key", F.lit('"')), F.col("key"), F.concat(F.lit("'"), "key", F.lit("',"))])
                        ).otherwise(pick(8, [F.col("other"), F.concat("other", F.lit(".")), F.concat("other", F.lit(",")), F.concat(F.lit("("), "other", F.lit(")"))]))
    shown = written(made.select("id", "path", "is_key", "name", "w", bare.alias("bare"), before.alias("before"), written_as.alias("word")), "findings")
    before2 = F.when(F.col("is_key") & ~F.col("bare") & (F.length("before") <= 1), F.col("name")).otherwise(word(1))
    found = shown.select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("doc_key"), "path", F.col("id").alias("pos"),
                         F.regexp_extract("word", RUN, 0).alias("candidate"), "word", before2.alias("before2"), "before",
                         word(2).alias("after"), F.col("is_key").cast("double").alias("label"))
    return found.where(F.length("candidate") >= 16)


def train(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """A forest from labelled findings with coverage: as many rows as were reviewed or generated, in one partition so that
    the forest is the same each time."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(findings)).select("doc_key", "pos", "features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", subsamplingRate=0.8,
                                    maxBins=32, maxMemoryInMB=32)
    return forest.fit(rows.repartition(1).sortWithinPartitions("doc_key", "pos"))


def scan(docs: DataFrame, reviewed: DataFrame | None = None, threshold: float = 0.5, generated_rows: int = 6000,
         id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, doc_key, pos, candidate, digest, length, coverage, score, is_secret): every candidate and the forest's verdict.

    score is the forest's share of trees for "secret", is_secret whether it reaches the threshold, digest the SHA-256 of the
    candidate for reports that must not show it. `reviewed` adds labelled findings (columns of `candidates`, and label)
    to the generated ones. Null, empty and blank texts have no candidates; a null doc_id stays null; repeated rows give
    their candidates again. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    found = written(candidates(docs, id_col, text_col, path_col), "candidates")
    findings = generated_findings(spark, generated_rows)
    if reviewed is not None:
        findings = findings.unionByName(reviewed.select(findings.columns))
    findings = written(findings, "findings")
    wanted = reduce(DataFrame.union, (x.select(F.explode(parts_of(F.col("candidate"))).alias("part")) for x in (found, findings)))
    known = written(dictionary(docs, written(wanted.distinct(), "parts"), text_col), "dictionary")
    forest = train(with_coverage(findings, known))
    seen = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(with_coverage(found, known)))
    scored = forest.transform(seen).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "doc_key", "pos", "candidate", F.sha2("candidate", 256).alias("digest"), F.col("length").cast("long").alias("length"),
                         "coverage", "score", (F.col("score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret of `scan` replaced in the text; all rows and columns stay as they are otherwise."""
    key, given_id, given_key, own = free_names(docs, "key", "given_id", "given_key", "secrets")
    secrets = (found.where("is_secret").groupBy(F.col("doc_id").alias(given_id), F.col("doc_key").alias(given_key))
               .agg(F.array_sort(F.collect_set("candidate"), lambda a, b: F.length(b) - F.length(a)).alias(own)))
    keyed = docs.withColumn(key, doc_key(id_col, text_col)).join(
        secrets, (F.col(key) == F.col(given_key)) & F.col(id_col).eqNullSafe(F.col(given_id)), "left")
    text = F.when(F.col(own).isNotNull(), F.aggregate(
        own, F.col(text_col), lambda text, secret: F.replace(text, secret, F.lit(mark)))).otherwise(F.col(text_col))
    return keyed.withColumn(text_col, text).select(*docs.columns)
