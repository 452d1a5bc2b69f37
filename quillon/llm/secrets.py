"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values that a key word assigns, and runs of 16 or more characters of keys with a digit anywhere in them
or a capital behind a letter (unassigned runs of small letters alone are none). Each is described by its length, the changes
between kinds of character, how much of it dictionary words cover, its path and the words beside it, before and after. A random forest, fitted on labelled findings, tells secrets from false positives.

Everything is DataFrame expressions and Spark's own forest. Defined results: null and empty texts have no
candidates; repeated rows give the same findings each; whole texts are scanned, and a finding's context stops at its
neighbours; an empty table gives no findings; a null path counts as empty; further columns are left alone, also
where they are named like the operator's.

Which letters follow which is counted over the distinct words (3 to 24 letters a to z) of all documents at hand, whole texts.
Every one of these words, shouted and joined with others, is a labelled false positive beside those made by rule: whatever the
language, its words are no secrets. However many they are, all words together weigh no more than WORDS findings made by rule.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm._common import written

#: Key words that assign secrets, words beside other long values, places of examples, common words.
ASSIGNS = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
CANDIDATE = ASSIGNS + r"[^\s\"']{8,}|(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9]|[A-Za-z_+/=-]*?[A-Za-z][A-Z])[A-Za-z0-9_+/=-]{16,}"
SECRET_WORDS = r"(?i)pass(word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private"
OTHER_WORDS = r"(?i)sha-?\d*|md5|commit|checksum|digest|hash|integrity|uuid|guid|rev(ision)?\b|etag|build|order|number|phone|card|isbn|def |class |import |function"
EXAMPLES = r"(?i)test|spec|example|fixture|sample|mock|docs?/|vendor|\.min\."
DICTIONARY = """
    access account action admin after agent alpha application array auth base batch before begin beta block body buffer build cache call
    case change changeme check class client code column command commit common component config connect content context control count
    create current custom data database date debug default delete demo description detail device dummy element email enable engine
    error event example fake false field file filter first foo folder footer form format from function get group handler hash header
    hello here host http https image index info input insert invalid item job json just key last length level library line link list
    load local location log login main manager master max message method min mode model module mouse my name network new node none
    null number object off old open option order page param parent password path pattern placeholder player point port position
    print process profile project property query random read record redacted region release remote remove report request resource
    response result return root row rule run sample save schema script search secret select send server service session set shared
    size sort source spec start state static status stop storage store string style support system table target task template test
    text the this thread time title todo token tool total track true type undefined unit update upload url user util value version
    view web width window with word work world write your
""".split()
FEATURES = ["n", "digits", "upper", "lower", "changes", "distinct", "hexadecimal", "numeric", "dictionary", "transitions", "assigned", "secret_word", "other_word", "closed", "called", "after_secret_word", "after_other_word", "example", "depth"]

#: Trees and their depth; labelled findings of a task, and words of a block, about.
TREES, DEPTH, ROWS = 24, 8, 100_000
#: Characters before and behind a value that are looked at; distinct characters that count as many.
BEFORE, AFTER, ALPHABET = 48, 16, 64
#: What counts as a word once lower-cased, letters of the shortest and the longest, marks around it; findings made by rule that all words weigh at most (and words drawn, where only counts are at hand).
SHORTEST, LONGEST, START, END, WORDS = 3, 24, "^", "$", 2_000
WORD = rf"(?<![\p{{L}}\p{{N}}])[a-z]{{{SHORTEST},{LONGEST}}}+(?![\p{{L}}\p{{N}}])"


class Detector(NamedTuple):
    """A forest and the log2 odds of each letter behind each other one (27 * first + second, from a)."""

    forest: RandomForestClassificationModel
    transitions: list[float]


def share(value: Column, pattern: str) -> Column:
    """Of a string's characters, the share that the pattern's matches cover."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct words of all documents, whole texts, lower-cased."""
    return docs.select(F.col(text).alias("_text")).select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(_text), {quoted(WORD)}, 0)"))).alias("word")).distinct()


def letter_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each three neighbouring letters stand in the distinct words of all documents."""
    return triple_counts(distinct_words(docs, text))


def triple_counts(words: DataFrame) -> dict[str, int]:
    """How often each three neighbouring letters stand in the words; START twice before a word and END behind it. At most 27 * 27 * 27 counts reach the driver."""
    return dict(triples(words).groupBy("triple").count().collect())


def triples(words: DataFrame) -> DataFrame:
    marked = F.concat(F.lit(2 * START), "word", F.lit(END))
    return words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(marked, i, F.lit(3)))).alias("triple"))


def learned_transitions(counts: dict[str, int]) -> list[float]:
    """log2 of how likely each letter is behind each other one, in the counted words and the dictionary."""
    seen = Counter(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1))
    for triple, n in counts.items():
        seen[triple[1:]] += n
    out = [0.0] * 27 * 27
    for a in range(26):
        row = [seen[chr(97 + a) + chr(97 + b)] + 0.5 for b in range(26)]
        for b in range(26):
            out[27 * a + b] = math.log2(row[b] / sum(row))
    return out


def typical_words(counts: dict[str, int], n: int = WORDS, seed: int = 11) -> list[str]:
    """n words drawn letter by letter, each letter as often behind the two before it as in the counted words; none if no word was counted."""
    behind: dict[str, tuple[list[str], list[int]]] = {}
    for triple, k in sorted(counts.items()):
        letters, weights = behind.setdefault(triple[:2], ([], []))
        letters.append(triple[2])
        weights.append(k)
    draw, out = random.Random(seed), []
    while counts and len(out) < n:
        word = 2 * START
        while word[-1] != END:
            word += draw.choices(*behind[word[-2:]])[0]
        if SHORTEST <= len(word) - 3 <= LONGEST:
            out.append(word[2:-1])
    return out


def mean_transition(value: Column, transitions: list[float]) -> Column:
    """The mean log2 odds of a value's neighbouring letters; 0 without any. One pass over its characters."""
    inside = lambda c: (c >= 0) & (c < 26)

    def step(so_far: Column, character: Column) -> Column:
        code = F.ascii(character) - 97
        both = inside(so_far["last"]) & inside(code)
        total = F.when(both, so_far["total"] + F.get(F.lit(transitions), 27 * so_far["last"] + code)).otherwise(so_far["total"])
        return F.struct(code.alias("last"), total.alias("total"), (so_far["n"] + F.when(both, 1).otherwise(0)).alias("n"))

    none = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    return F.aggregate(F.split(F.lower(value), ""), none, step, lambda a: F.when(a["n"] > 0, a["total"] / a["n"]).otherwise(0.0))


def features(findings: DataFrame, transitions: list[float]) -> DataFrame:
    """The findings (value, before, after, path) with a column for each of FEATURES in the struct `f`."""
    v, before, after, path = F.col("value"), F.col("before"), F.coalesce("after", F.lit("")), F.coalesce("path", F.lit(""))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    pieces = F.filter(F.split(F.lower(v), "[^a-z]+"), lambda w: F.length(w) >= 2)
    words = F.filter(pieces, lambda w: F.array_contains(F.array(*map(F.lit, DICTIONARY)), w))
    covered = F.length(F.array_join(words, "")) / F.greatest(F.length(v), F.lit(1))
    assigned = before.rlike(r"[:=]\s{0,3}[\"']?$")
    told = {
        "n": F.log2(F.length(v) + 1.0),
        "digits": share(v, "[0-9]"),
        "upper": share(v, "[A-Z]"),
        "lower": share(v, "[a-z]"),
        "changes": F.length(kinds) / F.greatest(F.length(v), F.lit(1)),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(F.greatest(F.length(v), F.lit(1)), F.lit(ALPHABET)),
        "hexadecimal": v.rlike("^[0-9a-fA-F-]+$"),
        "numeric": v.rlike("^[0-9 .,:/+-]+$"),
        "dictionary": covered,
        "transitions": mean_transition(v, transitions),
        "assigned": assigned,
        "secret_word": before.rlike(SECRET_WORDS),
        "other_word": before.rlike(OTHER_WORDS),
        "closed": after.rlike("^[\"']"),
        "called": after.rlike(r"^\s?[(.\[]"),
        "after_secret_word": after.rlike(SECRET_WORDS),
        "after_other_word": after.rlike(OTHER_WORDS),
        "example": path.rlike(EXAMPLES),
        "depth": F.size(F.split(path, "/")),
    }
    return findings.withColumn("f", F.struct(*(F.coalesce(told[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES)))


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Findings as a reviewer labels them, made by rule from hashes: (value, before, after, path, label)."""
    h = F.sha2(F.col("id").cast("string"), 256)
    word = lambda salt: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    upper = F.upper(F.translate(F.substring(F.base64(F.unhex(h)), 3, 40), "+/=abc", "XYZ234"))
    b64 = F.translate(F.base64(F.unhex(h)), "=", "")
    letters = F.translate(b64, "0123456789+/", "QbRdTfVhXjZm")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    number = F.translate(h, "abcdef", "")
    prose = F.concat_ws(" ", word(1), word(2), word(3))
    path = F.concat_ws("/", F.lit("src"), word(4), word(5))
    place = F.when(F.pmod(F.col("id"), F.lit(3)) == 0, F.concat(F.lit("src"), (F.col("id") % 20).cast("string"))).otherwise(path)
    kinds = [
        ("token", 1, F.substring(h, 1, 40), F.concat(prose, F.lit(' token = "'))),
        ("password", 1, F.substring(h, 1, 18), F.concat(prose, F.lit(" password="))),
        ("short password", 1, F.substring(b64, 2, 12), F.concat(prose, F.lit(' secret: "'))),
        ("access id", 1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.concat(prose, F.lit(" "))),
        ("access id alone", 1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.lit("")),
        ("service key", 1, F.substring(b64, 1, 40), F.concat(prose, F.lit(" api_key: "))),
        ("prefixed", 1, F.concat(F.lit("ghp_"), F.substring(F.translate(b64, "+/", "ab"), 1, 36)), F.concat(word(1), F.lit(" "))),
        ("bearer", 1, F.concat(F.lit("eyJ"), b64), F.lit("Authorization: Bearer ")),
        ("commit", 0, F.substring(h, 1, 40), F.concat(prose, F.lit(" commit "))),
        ("checksum", 0, h, F.concat(word(1), F.lit(" sha256 "))),
        ("digest", 0, F.substring(h, 1, 32), F.concat(word(1), F.lit(" md5: "))),
        ("uuid", 0, uuid, F.concat(word(1), F.lit(" id "))),
        ("placeholder", 0, F.concat_ws("-", word(1), word(2), F.lit("here")), F.lit('token = "')),
        ("masked", 0, F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.substring(number, 1, 2)), F.lit("password=")),
        ("expression", 0, F.concat(word(1), F.lit("."), word(2), F.lit("('"), word(3)), F.lit("password = ")),
        ("identifier", 0, F.concat_ws("_", word(1), word(2), word(3), F.lit("v2")), F.lit("def ")),
        ("file", 0, F.concat_ws("/", word(1), word(2), F.substring(number, 1, 4), word(3)), F.concat(word(4), F.lit(" "))),
        ("number", 0, F.substring(number, 1, 16), F.concat(prose, F.lit(" "))),
        ("words", 0, F.concat(word(1), word(2), word(3), F.lit("1")), F.concat(prose, F.lit(" "))),
        ("letters id", 1, F.concat(F.lit("AKIA"), F.substring(F.translate(upper, "0123456789", "QWERTYUIOP"), 1, 16)), F.concat(prose, F.lit(" "))),
        ("letters key", 1, F.substring(letters, 1, 40), F.concat(prose, F.lit(" "))),
        ("camel case", 0, F.concat(word(1), *(F.initcap(word(k)) for k in (2, 3, 7))), F.concat(prose, F.lit(" "))),
        ("capitals", 0, F.upper(F.concat_ws("_", word(1), word(2), word(3), word(7))), F.concat(prose, F.lit(" "))),
        ("example", 0, F.substring(h, 1, 40), F.lit('token = "')),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    pick = lambda at: F.coalesce(*(F.when(kind == i, k[at] if isinstance(k[at], Column) else F.lit(k[at])) for i, k in enumerate(kinds)))
    where = F.when(kind == len(kinds) - 1, F.concat(F.lit("tests/fixtures/"), word(6))).otherwise(place)
    # the words behind: what closes or calls the value, then prose; every sixth one ends its text
    closing = F.when(pick(3).rlike("\"$"), F.lit('"')).when(pick(0) == "identifier", F.lit("(")).when(pick(0) == "expression", F.lit("')")).otherwise(F.lit(""))
    after = F.when(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(6)) == 0, closing).otherwise(F.substring(F.concat_ws(" ", closing, word(8), word(9)), 1, 16))
    return spark.range(n).select(pick(2).alias("value"), pick(3).alias("before"), after.alias("after"), where.alias("path"), pick(1).cast("double").alias("label"))


def dealt(words: DataFrame) -> DataFrame:
    """(word, block, place): all words, dealt by a hash to blocks of about ROWS and numbered there; words should be cheap to count, as a written table is."""
    h, blocks = F.xxhash64("word"), 1 + words.count() // ROWS
    own = words.select("word", F.pmod(h, F.lit(blocks)).alias("block"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(h, "word")))


def word_findings(words: DataFrame) -> DataFrame:
    """False positives as prose has them: a finding for each word (word, block, place) but a block's last six, which stand in others: words neighbouring in a block, shouted, joined in several ways, within other words."""
    place = Window.partitionBy("block").orderBy("place")
    w = [F.lead("word", k).over(place) for k in range(7)]
    own = words.select(*(c.alias(f"w{k}") for k, c in enumerate(w)), "place").where("w6 is not null")
    joined = lambda sep, *k: F.concat_ws(sep, *(F.col(f"w{i}") for i in k))
    kinds = [
        F.upper(joined("", 0, 1, 2)), F.initcap(joined(" ", 0, 1, 2, 3)), F.upper(joined("-", 0, 1, 2)), F.concat(F.upper(joined("", 0, 1)), joined("", 2, 3)), F.upper(joined("", 0, 1, 2, 3)), F.initcap(joined("", 0, 1, 2)),
    ]
    kind = F.pmod(F.col("place"), F.lit(len(kinds)))
    value = F.regexp_replace(F.coalesce(*(F.when(kind == i, k) for i, k in enumerate(kinds))), " ", "")
    shout = F.pmod(F.xxhash64("place"), F.lit(2)) == 0
    near = lambda c: F.when(shout, F.upper(c)).otherwise(c)
    before = F.concat(near(joined(" ", 4, 5)), F.when(F.pmod(F.xxhash64("place", F.lit(1)), F.lit(4)) == 0, ". ").otherwise(" "))
    after = F.concat(F.when(F.pmod(F.xxhash64("place", F.lit(2)), F.lit(4)) == 0, ".").otherwise(" "), near(F.col("w6")))
    path = F.concat(F.lit("src"), (F.col("place") % 20).cast("string"))
    found = own.select(value.alias("value"), before.alias("before"), F.substring(after, 1, AFTER).alias("after"), path.alias("path"), F.lit(0.0).alias("label"))
    return found.where(F.length("value") >= 16)


def fit(findings: DataFrame, counts: dict[str, int], words: DataFrame | None = None, seed: int = 11) -> Detector:
    """A forest fitted on all labelled findings (value, before, after, path, label), and on all words (word) as false positives; without words, on ones drawn by the counts."""
    transitions = learned_transitions(counts)
    if words is None:
        own = findings.sparkSession.createDataFrame(list(enumerate(typical_words(counts))), "place int, word string").withColumn("block", F.lit(0))
        weight = 1.0
    else:
        own, weight = dealt(words), min(1.0, WORDS / max(1, words.count()))
    every = findings.withColumn("weight", F.lit(1.0)).unionByName(word_findings(own).withColumn("weight", F.lit(weight)))
    described = written(features(every, transitions).select("f", "label", "weight"), "findings")
    # rows lie in tasks by their hash, in order: the same findings give the same forest in every session
    order = [F.xxhash64("f"), "f", "label", "weight"]
    placed = described.repartition(1 + described.count() // ROWS, order[0]).sortWithinPartitions(*order)
    rows = vectors(placed).select("features", "label", "weight")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", weightCol="weight").fit(rows)
    return Detector(forest, transitions)


def detector(docs: DataFrame, text: str = "text") -> Detector:
    """Fitted on findings by rule and on all words of these documents."""
    words = written(distinct_words(docs, text), "words")
    return fit(labelled_findings(docs.sparkSession), triple_counts(words), words)


def vectors(described: DataFrame) -> DataFrame:
    flat = described.select("*", *(F.col("f")[k].alias(f"_f_{k}") for k in FEATURES))
    return VectorAssembler(inputCols=[f"_f_{k}" for k in FEATURES], outputCol="features").transform(flat).drop(*(f"_f_{k}" for k in FEATURES))


def candidates(docs: DataFrame, text: str, path: str | None, keep: list[Column]) -> DataFrame:
    """A row for each candidate: row (a number of the document's row), place, keep, gap before it, lead (what assigns it), value, before, after, path, tail (the text behind the last one)."""
    own = docs.where(F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False)))
    own = own.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("keep"), (F.col(path).cast("string") if path else F.lit("")).alias("path"), F.col(text).alias("_text"))
    own = own.select("row", "keep", "path", F.expr(f"regexp_extract_all(_text, {quoted(CANDIDATE)}, 0)").alias("m"), F.split("_text", CANDIDATE, -1).alias("g"))
    each = own.select("row", "keep", "path", F.posexplode(F.arrays_zip("m", "g", F.expr("slice(g, 2, size(m))").alias("h"))).alias("place", "c"), F.size("m").alias("of"))
    lead = F.regexp_extract("c.m", "^" + ASSIGNS, 0)
    return (
        each.where("c.m is not null")
        .select("row", "keep", "path", "place", F.col("c.g").alias("gap"), lead.alias("lead"), F.expr("c.m").alias("match"), F.col("c.h").alias("next"), "of")
        .withColumn("value", F.expr("substring(match, length(lead) + 1)"))
        .withColumn("before", F.concat(F.expr(f"right(gap, {BEFORE})"), "lead"))
        .withColumn("after", F.expr(f"left(next, {AFTER})"))
        .withColumn("tail", F.when(F.col("place") == F.col("of") - 1, F.col("next")))
        .drop("next", "of", "match")
    )


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scored(found: DataFrame, model: Detector, threshold: float) -> DataFrame:
    told = model.forest.setFeaturesCol("features").transform(vectors(features(found, model.transitions)))
    score = F.round(vector_to_array("probability")[1], 6)
    return told.withColumn("score", score).withColumn("secret", score >= threshold).drop("features", "rawPrediction", "probability", "prediction", "f")


def scan(docs: DataFrame, model: Detector | None = None, threshold: float = 0.5, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row for each candidate: key, start and length in characters, assigned, score (0 to 1) and secret."""
    model = model or detector(docs, text)
    found = scored(candidates(docs, text, path, [F.col(key).alias("key")]), model, threshold)
    so_far = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("gap") + F.length("lead") + F.length("value")).over(so_far)
    return found.select(F.col("keep.key").alias(key), (end - F.length("value")).cast("long").alias("start"), F.length("value").cast("long").alias("length"), (F.length("lead") > 0).alias("assigned"), "score", "secret")


def redact(docs: DataFrame, model: Detector | None = None, threshold: float = 0.5, mark: str = "[SECRET]", text: str = "text", path: str | None = None) -> DataFrame:
    """The documents with each secret's characters replaced by the mark; documents without candidates pass as they are."""
    model = model or detector(docs, text)
    rest = [c for c in docs.columns if c != text]
    found = scored(candidates(docs, text, path, [F.col(c) for c in rest] or [F.lit(0).alias("_")]), model, threshold)
    piece = F.concat("gap", "lead", F.when(F.col("secret"), F.lit(mark)).otherwise(F.col("value")), F.coalesce("tail", F.lit("")))
    whole = found.groupBy("row").agg(F.first("keep").alias("keep"), F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"))
    changed = whole.select(*(F.array_join("pieces.piece", "").alias(text) if c == text else F.col("keep")[c].alias(c) for c in docs.columns))
    plain = docs.where(~F.coalesce(F.col(text).rlike(CANDIDATE), F.lit(False)))
    return plain.unionByName(changed)
