"""Operator 6: secret scan with a random forest against false positives.

Native: DataFrame functions and the JVM's random forest only.

Candidates are blank-free words of at least ``LENGTH_LEAST`` characters with a
digit or an assignment sign or three changes from small to capital letters, and, whatever their length and characters, words
that assign a value to a key and the two words after a key word that has no
value yet ("password: x", "password is x"; not signs alone).  A word that
begins with a key gives a candidate for each of its key-value pairs, another
one for itself and for the pairs inside; a password in an address and each
match of a strict format inside a word is one as well.  Their features: length, shares of character
classes, transitions between classes, distinct characters, dictionary
coverage (letter runs that are words of the whole corpus, joined), path and
address marks, and the neighbouring words.  The forest is trained on labelled
findings: those given, or else findings that ``label`` can decide by strict
formats and assignments (secrets) or by plain other uses (addresses, numbers,
paths, words; after a key too, single words of the dictionary and numbers of
under ``VALUE_LEAST`` characters); at most ``SAMPLE_MOST`` of either label,
smallest hash first.
Every candidate is scored; a plain word of the dictionary or a short number is
no secret, whatever the forest says.

Values stay secret: no written table holds a value, a word or a neighbour, only
features, masked forms and hashes with a salt of the call.  Masks show the ends
of values of ``SHOW_LEAST`` characters or more, of others the length alone, and
only the former have a fingerprint.

Findings are replaced wherever their value stands in the text of their own row
(rows are told apart by a hash of id and text), values of under ``VALUE_LEAST``
characters only where no letter or digit is next to them.

Cases: NULL and empty texts have no candidates; equal findings of a document
are reported once a place; rows that repeat an id (or have none) report and
lose their findings each by itself; ties in the training sample go to the
smaller features; very long texts are scanned whole, in one row; without findings of both labels the score is the label (0 where there is
none); empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.llm.components import written
from revlens.operators.hygiene import fingerprint, mask

LENGTH_LEAST = 12
VALUE_LEAST = 8
SHOW_LEAST = 20
SAMPLE_MOST = 4_000
WORD_COUNT_LEAST = 3
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5
REPLACEMENT = "[SECRET]"

BLANKS = r"[\x20\x09-\x0D]+"
KEY_WORDS = r"(?i)(token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
#: A key word with its value in the same word.
SERVED = r"^[^\w]*[\w\-]*" + KEY_WORDS + r"[\w\-]*[\"']?(?:=|:)(?!//)[\"']?\w"
#: A key with its sign of assignment; the value follows.
_KEY = r"([A-Za-z_][A-Za-z0-9_\-]*+)[\"']?[=:]{1,2}>?(?!//)"
_OPEN = r"[\"'({\[<]*"
#: A word that begins with a key and a value assigned to it.
KEYED = "^" + _OPEN + _KEY + r"[\"']?\S"
#: Every key-value pair of a word: the value ends where the next pair begins.
_PAIR = r"(?<![A-Za-z0-9_])(?<![A-Za-z0-9_]-)(?<!//)" + _KEY
PAIR = _PAIR + r"(\S*?)(?=$|[,;&|?#{\[(]" + _OPEN + _KEY.replace("(", "(?:", 1) + ")"
#: An address with a password before the host; one whose query has a key word as a key.
USER_PART = r"://[^/\s:@?#]*:([^/\s@]+)@"
KEYED_QUERY = r"://\S*[?&;#][^=&;\s]*" + KEY_WORDS + r"[^=&;\s]*="
#: Strict formats: access key ids, and the prefixes of the library's key table.
_FORMAT = r"(?:AKIA[0-9A-Z]{16}|(?:" + "|".join(sorted({p for ps in K.KEY_PREFIXES.values() for p in ps}, key=lambda p: (-len(p), p))) + \
    r")[A-Za-z0-9_\-]{16,}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)"
FORMATS = "^" + _FORMAT + "$"
#: The same inside a word.
FORMAT_INSIDE = "(?<![A-Za-z0-9])(" + _FORMAT + ")(?![A-Za-z0-9])"
#: Plain other uses: addresses, numbers, dates, paths and file names, words.
OTHERS = (r"^(?:[^@\s]+@[A-Za-z0-9.\-]+|[0-9.,:/+()\-]+|(?i:https?|ftp)://\S*|[A-Za-z]:\\\S*|~?/\S*|[\w.\-]+/[\w./\-]+"
          r"|[A-Za-z_\-]+[0-9]{0,3}|[\w\-]+\.[A-Za-z]{1,5})$")
#: What a key can be followed by without a secret: a plain word, a short number.
PLAIN_WORD, PLAIN_NUMBER = "^[A-Za-z]?[a-z]+$", "^[0-9.,:/+()\\-]+$"
FEATURES = ("length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "coverage", "hexadecimal", "slashes",
            "at_sign", "dots", "key_before", "key_inside", "assigned", "quoted", "prev_length", "next_length")


def _share(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]", "")) / F.length(value)


def _row_keys(id_value: Column, text: Column, salt: int) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    return [F.xxhash64(id_value, text, F.lit(salt + i)).alias(f"row{i}") for i in (1, 2)]


def value_key(value: Column, salt: int) -> Column:
    return F.xxhash64(value, F.lit(salt))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: int = 0) -> DataFrame:
    """(row1, row2, doc_id, word_no, word, before, before2, after) of every candidate."""
    words = docs.select(*_row_keys(docs[id_col], docs[text_col], salt), docs[id_col].alias("doc_id"), F.split(F.coalesce(docs[text_col], F.lit("")), BLANKS).alias("w"))
    words = words.select("*", F.transform("w", lambda x: x.rlike(KEY_WORDS) & ~x.rlike(SERVED)).alias("k"))
    word = lambda i: F.get(F.col("w"), i)
    key = lambda i: F.coalesce(F.get(F.col("k"), i), F.lit(False))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(word(i)) >= LENGTH_LEAST) & word(i).rlike("[0-9=]|(?:[a-z][^a-z]*?[A-Z].*?){3}")
                  | (word(i).contains(":") | word(i).contains("=")) & word(i).rlike(_PAIR + r"[\"']?\S")
                  | (F.length(word(i)) >= LENGTH_LEAST) & word(i).rlike(FORMAT_INSIDE) | (key(i - 1) | key(i - 2)) & ~word(i).rlike("^[=:>-]*$"))
    found = F.transform(at, lambda i: F.struct(
        i.cast("bigint").alias("word_no"), word(i).alias("word"), F.coalesce(word(i - 1), F.lit("")).alias("before"),
        F.coalesce(word(i - 2), F.lit("")).alias("before2"), F.coalesce(word(i + 1), F.lit("")).alias("after")))
    return words.select("row1", "row2", "doc_id", F.explode(found).alias("c")).select("row1", "row2", "doc_id", "c.*")


def values(found: DataFrame) -> DataFrame:
    """A row for each value of the word, with its key: of every key-value pair,
    of a password in an address (as if its key were "password"), of every
    strict format, and the word itself unless it begins with a key; without
    quotation marks and closing punctuation, equal ones once."""
    part = lambda key, value: F.struct(key.alias("key"), F.regexp_replace(F.regexp_replace(
        value, r"^[\"'`({\[<]+", ""), r"[\"'`)}\]>,;.:!?]+$", "").alias("value"))
    every = lambda pattern, group: F.regexp_extract_all("word", F.lit(pattern), group)
    word = F.filter(F.array(part(F.lit(""), F.col("word"))), lambda p: ~F.col("word").rlike(KEYED))
    pairs = F.zip_with(every(PAIR, 1), every(PAIR, 2), part)
    users = F.transform(every(USER_PART, 1), lambda v: part(F.lit("password"), v))
    keyed = found.withColumn("parts", F.array_distinct(F.concat(word, pairs, users))).withColumn("formats", every(FORMAT_INSIDE, 1))
    formats = F.transform(F.array_except("formats", F.transform("parts", lambda p: p["value"])), lambda v: part(F.lit(""), v))
    out = keyed.withColumn("part", F.explode(F.concat("parts", formats))).select(*found.columns, "part.*")
    near = (F.col("key") != "") | F.concat_ws(" ", "before2", "before").rlike(KEY_WORDS)
    return out.where((F.length("value") >= VALUE_LEAST) | (F.length("value") > 0) & near)


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Words (letter runs of 3 to 24, lower case) of the whole corpus that
    occur ``WORD_COUNT_LEAST`` times or more."""
    word = docs.select(F.explode(F.split(F.lower(F.coalesce(docs[text_col], F.lit(""))), "[^a-z]+")).alias("segment"))
    return word.where(F.length("segment").between(3, 24)).groupBy("segment").count().where(
        F.col("count") >= WORD_COUNT_LEAST).select("segment")


def features(found: DataFrame, words: DataFrame, salt: int = 0) -> DataFrame:
    """Findings with the forest's features and what ``label`` needs, and
    without their values, words and neighbours."""
    v, f_length = F.col("value"), F.length("value")
    context = F.concat_ws(" ", "before2", "before")
    cols = {
        "length": f_length, "digits": _share(v, "0-9"), "uppers": _share(v, "A-Z"), "lowers": _share(v, "a-z"),
        "others": 1 - _share(v, "A-Za-z0-9"),
        "transitions": F.regexp_count(v, F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]")) / f_length,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / f_length,
        "hexadecimal": v.rlike("^[0-9a-fA-F]+$"), "slashes": F.regexp_count(v, F.lit(r"[/\\]")), "at_sign": v.contains("@"),
        "dots": F.regexp_count(v, F.lit(r"\.")), "key_before": (F.col("key") == "") & context.rlike(KEY_WORDS), "key_inside": F.col("key").rlike(KEY_WORDS),
        "assigned": (F.col("key") != "") | F.col("before").rlike("[=:]$"), "quoted": F.col("word").rlike("[\"'`]"),
        "prev_length": F.length("before"), "next_length": F.length("after"),
    }
    digit = v.rlike("[0-9]")
    told = {
        "strict": v.rlike(FORMATS), "other": v.rlike(OTHERS) & ~v.rlike(USER_PART) & ~v.rlike(KEYED_QUERY),
        # the fewer characters, the less a digit says
        "telling": digit & ((f_length >= VALUE_LEAST) | (f_length >= 6) & v.rlike("[A-Za-z]")),
        "plain_word": v.rlike(PLAIN_WORD), "plain_number": v.rlike(PLAIN_NUMBER) & (f_length < VALUE_LEAST),
    }
    shown = f_length >= SHOW_LEAST
    runs = F.transform(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{3,24})"), 1),
                       lambda x: F.struct(F.xxhash64(x, F.lit(salt)).alias("h"), F.length(x).alias("n")))
    safe = written(found.select(
        F.monotonically_increasing_id().alias("row"), "row1", "row2", "doc_id", "word_no", value_key(v, salt).alias("value_key"),
        F.when(shown, mask(v)).otherwise(F.concat(F.lit("SET ("), f_length.cast("string"), F.lit(" chars)"))).alias("masked"),
        F.when(shown, fingerprint(v)).alias("fingerprint"), *[c.cast("double").alias(n) for n, c in cols.items()],
        *[c.alias(n) for n, c in told.items()], runs.alias("runs")), "candidates")
    parts = safe.select("row", F.explode("runs").alias("r")).select("row", "r.h", "r.n")
    covered = (parts.join(words.select(F.xxhash64("segment", F.lit(salt)).alias("h")), "h").groupBy("row").agg(F.sum("n").alias("covered")))
    coverage = (F.coalesce("covered", F.lit(0)) / F.col("length")).cast("double").alias("coverage")
    return safe.join(covered, "row", "left").select(*[c for c in safe.columns if c not in ("row", "runs")], coverage)


def _plain() -> Column:
    """A single word of the dictionary (or of one or two letters), a short number."""
    return F.col("plain_word") & ((F.col("coverage") >= 1) | (F.col("length") < 3)) | F.col("plain_number")


def label(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 secret, 0 not, NULL undecided."""
    named = (F.col("key_inside") == 1) | ((F.col("key_before") == 1) & (F.col("assigned") == 1))
    other = (F.col("key_inside") == 0) & (F.col("key_before") == 0) & F.col("other")
    return found.withColumn("label", F.when(F.col("strict") | (named & F.col("telling")), 1.0).when(other | _plain(), 0.0))


def train(labelled: DataFrame):
    """The forest, or None without findings of both labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    part = [labelled.where(F.col("label") == v).select("label", *FEATURES).withColumn("h", F.xxhash64(*FEATURES, F.lit(SEED))).orderBy(
        "h", *FEATURES).limit(SAMPLE_MOST).drop("h") for v in (0.0, 1.0)]
    sample = written(reduce(DataFrame.unionByName, part).coalesce(1), "findings-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample)
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)


def findings(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", salt: int | None = None) -> DataFrame:
    """All candidates with score and decision, masked; row1, row2 and
    value_key tell with the salt which value of which row they are."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    salt = secrets.randbits(60) if salt is None else salt
    f = written(label(features(values(candidates(docs, id_col, text_col, salt)), dictionary(docs, text_col), salt)), "findings")
    model = train(f.where("label is not null") if labelled is None else labelled)
    if model is None:
        scored = f.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(f)).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select("row1", "row2", "value_key", "doc_id", "word_no", "masked", "fingerprint", F.col("length").cast("bigint").alias("length"),
                         "score", ((F.col("score") >= THRESHOLD) & ~_plain()).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate, masked."""
    return findings(docs, labelled, id_col, text_col).drop("row1", "row2", "value_key")


def _alone(value: Column) -> Column:
    """Pattern of the value without a letter or digit next to it."""
    quoted = F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), quoted, F.lit("\\E(?![A-Za-z0-9])"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with the secrets in their texts replaced.
    The values are found again in the texts and kept only where the decisions
    have their hashes."""
    salt = secrets.randbits(60)
    place = ["row1", "row2", "word_no", "value_key"]
    decided = findings(docs, None, id_col, text_col, salt).where("is_secret").select(*place).distinct()
    found = values(candidates(docs, id_col, text_col, salt)).withColumn("value_key", value_key(F.col("value"), salt)).select(*place, "value")
    secret = found.join(decided, place, "left_semi").groupBy("row1", "row2").agg(      # the secrets of one text
        F.sort_array(F.collect_set(F.struct((-F.length("value")).alias("n"), "value"))).alias("_secrets"))
    secret = secret.withColumnsRenamed({"row1": "_row1", "row2": "_row2"})
    k1, k2 = _row_keys(docs[id_col], docs[text_col], salt)
    d = docs.join(secret, (k1 == F.col("_row1")) & (k2 == F.col("_row2")), "left")
    text = F.aggregate(F.coalesce("_secrets", F.array().cast("array<struct<n:int,value:string>>")), docs[text_col],
                       lambda t, s: F.when(-s["n"] >= VALUE_LEAST, F.replace(t, s["value"], F.lit(REPLACEMENT))).otherwise(
                           F.regexp_replace(t, _alone(s["value"]), F.lit(REPLACEMENT))))
    return d.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
