"""Secrets in texts: long tokens are findings, a random forest removes the false positives.

Words are split at quotes, brackets, commas, semicolons, ``?``, ``&``, ``|``, backslashes and what is not ASCII. A finding is a part with
a core of at least ``LEAST_CORE`` characters of the alphabets that secrets use, or else each such stretch in it; and a part of any
length where a name that speaks of a secret, and an assignment, stand before it. What
follows a name and ``=`` or ``:`` in a part is its value, so a value that holds one of those marks is found up to the mark. The forest sees, for the value: its length; shares of digits, capitals and
distinct characters; how often the character class changes and how usual its letter transitions are, against
those of the corpus' own words; the part covered by dictionary words; marks of paths and addresses; and from
its surroundings, whether the words before it, or its own name, speak of a secret, and whether an assignment stands there.

The dictionary - letter runs found ``DICTIONARY_COUNT`` times or more - and the transition table (at most 38 x 38) are counted
over all texts. The forest is trained on labelled findings, at most ``SAMPLE``, half of each kind where there are so many, the first in hash order, given by the caller or by
:func:`rule_labels`, which labels only the clear cases, together with :func:`injected` findings: up to ``INJECTED`` findings of the
corpus with another value or other words before it, whose labels follow from what was put there - random keys and keys of public formats where nothing
announces them, harmless values that are announced like a password, digests that nothing announces (no secrets). So neither the words before a value nor its looks decide alone.
All steps are DataFrame functions; spark.ml runs in the JVM.

Defined cases: NULL and empty texts have no findings; the same token twice is two findings; rows that repeat are scanned
alike; if the caller's labels are all of one kind, the rules decide (score 0.5 and no secret where they say nothing); an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, staged, text_of

LEAST_CORE = 16
LEAST_CLEAR = 8              # an announced, assigned value must be as long for a rule to call it a secret
DICTIONARY_COUNT = 5
SAMPLE, INJECTED = 20_000, 4_000
TREES, DEPTH, SEED = 40, 8, 11

# Words that announce a secret - whole ones, or parts of a name such as db_password, apiKey or AUTH_TOKEN - and public formats
# of keys and tokens.
ANNOUNCES = (r"(?<![A-Za-z])(?i:passw(or)?ds?|passwd|passphrase|pwd|secrets?|tokens?|api|apikey|keys?|auth|authorization|credentials?|bearer)(?![a-z])"
             r"|(?<=[a-z])(Passw(or)?ds?|Passwd|Passphrase|Pwd|Secrets?|Tokens?|Api|Keys?|Auth|Credentials?)(?![a-z])")
KEY_FORMATS = (r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}"
               r"|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)$")
ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+$|^(https?|ftp)[:.]|www\.|^/?([a-z0-9_.-]+/)+[a-z0-9_.-]*$"
PLACEHOLDER = r"(?i)(example|changeme|your[_-]|placeholder|xxxx|dummy|sample)"

_CLASSES = 38                      # 26 letters, 10 digits, anything else, the start
_FEATURES = ["length", "digits", "capitals", "distinct", "changes", "unusual", "covered", "slashes", "dots", "at_sign",
             "announced", "assigned"]
# Where words are split; control characters too, as no alphabet has them.
_MARKS = r'''\x00-\x1F\x7F"'`(){}\[\]<>,;?&|\\\x80-\x{10FFFF}'''
_ALPHABET = "[A-Za-z0-9_+/=.:@%~-]"
ASSIGNED = r"[=:]\W*$"
_LETTERS = r"\p{L}{3,}"


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, position (word number from 1), part (number of the part in its word, and of the stretch in it), value, and the text around it:
    name, before, after."""
    words = F.regexp_extract_all(text_of(), F.lit(f"({WORD})"))

    def at(i: Column) -> Column:
        return F.coalesce(F.get("words", (i - 1).cast("int")), F.lit(""))

    def speaks(i: Column) -> Column:
        near = F.concat_ws(" ", at(i - 2), at(i - 1), at(i))
        return near.rlike("[=:]") & near.rlike(ANNOUNCES)

    def word(i: Column) -> Column:
        return F.struct(i.alias("position"), at(i).alias("word"), at(i + 1).alias("next"),
                        F.when(i > 2, F.concat(at(i - 2), F.lit(" "), at(i - 1))).when(i > 1, at(i - 1)).otherwise("").alias("previous"))

    places = F.filter(F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"))).otherwise(F.array().cast("array<int>")),
                      lambda i: (F.length(at(i)) >= LEAST_CORE) | speaks(i))
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("words"))
            .select("doc_id", F.inline(F.transform(places, word)))
            .withColumn("items", F.regexp_extract_all("word", F.lit(f"([{_MARKS}]+|[^{_MARKS}]+)"))))

    def item(i: Column) -> Column:
        return F.coalesce(F.get("items", (i - 1).cast("int")), F.lit(""))

    def part(i: Column) -> Column:
        # The word's own text before the item: its name at most, with the marks around it.
        return F.struct(i.alias("item"), item(i).alias("own"), F.concat(item(i - 4), item(i - 3), item(i - 2), item(i - 1)).alias("ahead"),
                        (i == F.size("items")).alias("last"), item(i + 1).alias("behind"))

    parts = (rows.select("doc_id", "position", "next", "previous",
                         F.inline(F.transform(F.sequence(F.lit(1), F.size("items")), part)))
             .where(~F.col("own").rlike(f"^[{_MARKS}]"))
             .withColumn("core", F.regexp_replace("own", r"^[^A-Za-z0-9+/]+|[^A-Za-z0-9+/=]+$", ""))
             .where("core <> ''")
             # Another pair, or more of the word than was taken, stands between the item and the words before.
             .withColumn("before", F.when((F.col("item") > 5) | F.col("ahead").rlike("[,;&{}]"), F.regexp_extract("ahead", "[^,;&{}]*$", 0))
                         .when(F.col("ahead") == "", F.col("previous")).otherwise(F.concat_ws(" ", "previous", "ahead")))
             .withColumn("after", F.when(F.col("last"), F.col("next")).otherwise(F.col("behind"))))
    named = r"^([A-Za-z_.-]{2,30}[=:]+)(.*)$"
    around = F.concat_ws(" ", "before", F.regexp_extract("core", named, 1))
    assigned = around.rlike(ANNOUNCES) & around.rlike(ASSIGNED) & (F.regexp_replace("core", named, "$2") != "")
    cores = (F.when(F.col("core").rlike(f"^{_ALPHABET}{{{LEAST_CORE},}}$") | assigned, F.array("core"))
             .otherwise(F.regexp_extract_all("core", F.lit(f"({_ALPHABET}{{{LEAST_CORE},}})"))))
    found = parts.select("doc_id", "position", "item", "before", "after", F.posexplode(cores).alias("stretch", "core"))
    return found.select("doc_id", F.col("position").cast("bigint").alias("position"),
                        F.concat_ws(".", "item", F.col("stretch") + 1).alias("part"),
                        F.regexp_replace("core", named, "$2").alias("value"),
                        F.regexp_extract("core", named, 1).alias("name"), "before", "after")


def dictionary(docs: DataFrame, least: int = DICTIONARY_COUNT) -> DataFrame:
    """word, times: the letter runs of three characters and more that all texts together hold ``least`` times."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of()), F.lit(f"({_LETTERS})"))).alias("word"))
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least)


def _class(character: Column) -> Column:
    code = F.ascii(character)
    return (F.when((code >= 97) & (code <= 122), code - 97).when((code >= 48) & (code <= 57), code - 48 + 26).otherwise(36)).cast("int")


def _pairs(word: Column) -> Column:
    """Class pair numbers of all neighbouring characters of ``word``, the start counting as one."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: (
        F.when(i == 1, F.lit(_CLASSES - 1)).otherwise(_class(F.substring(word, i - 1, F.lit(1)))) * _CLASSES
        + _class(F.substring(word, i, F.lit(1)))))


def transitions(words: DataFrame) -> list[float]:
    """Minus log probability of each class after each class in the dictionary, smoothed; _CLASSES squared numbers."""
    counted = (words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "times").groupBy("pair")
               .agg(F.sum("times").alias("n")))
    left = F.floor(F.col("pair") / _CLASSES)
    every = words.sparkSession.range(_CLASSES * _CLASSES).select(F.col("id").cast("int").alias("pair"))
    table = (every.join(counted, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
             .groupBy(left.alias("left")).agg(F.collect_list(F.struct("pair", "n")).alias("row"), F.sum("n").alias("total"))
             .select(F.inline("row"), "total").select("pair", (F.log("total") - F.log("n")).alias("cost")))
    return [row.cost for row in table.orderBy("pair").collect()]                # always _CLASSES squared rows


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the forest's features. What only depends on the value is computed once per distinct value."""
    value = F.col("value")
    size = F.greatest(F.length(value), F.lit(1))
    costs = F.array(*map(F.lit, transitions(words)))
    values = staged(found.select("value").distinct(), "secret-values")
    runs = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(f"({_LETTERS})"))).alias("word"))
    covered = (runs.join(words.select("word"), "word", "left_semi").groupBy("value")
               .agg(F.sum(F.length("word")).alias("in_words")))
    own = values.join(covered, "value", "left").withColumn("costs", costs).select(
        "value", F.length(value).cast("double").alias("length"),
        (F.regexp_count(value, F.lit("[0-9]")) / size).alias("digits"),
        (F.regexp_count(value, F.lit("[A-Z]")) / size).alias("capitals"),
        (F.size(F.array_distinct(F.split(value, ""))) / size).alias("distinct"),
        (F.regexp_count(value, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / size).alias("changes"),
        (F.aggregate(_pairs(F.lower(value)), F.lit(0.0), lambda s, p: s + F.element_at(F.col("costs"), p + 1)) / size).alias("unusual"),
        (F.coalesce("in_words", F.lit(0)) / size).alias("covered"),
        F.regexp_count(value, F.lit("/")).cast("double").alias("slashes"),
        F.regexp_count(value, F.lit(r"\.")).cast("double").alias("dots"),
        F.contains(value, F.lit("@")).cast("double").alias("at_sign"))
    around = F.concat_ws(" ", "before", "name")
    return (found.join(own, "value")
            .withColumn("announced", around.rlike(ANNOUNCES).cast("double"))
            .withColumn("assigned", around.rlike(ASSIGNED).cast("double")))


def rule_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 for public key formats and announced, assigned values with digits and no words in them;
    0 for addresses, paths, placeholders, plain words and plain numbers; NULL where neither is clear."""
    value = F.col("value")
    plain = value.rlike("^[A-Za-z]+$") & (F.col("covered") > 0.5) | value.rlike("^[0-9]+$") | value.rlike("^[a-z]+([-_][a-z]+)*$")
    return found.withColumn("label", F.when(value.rlike(ADDRESS) | value.rlike(PLACEHOLDER), 0.0)
                            .when(value.rlike(KEY_FORMATS), 1.0).when(plain, 0.0)
                            .when((F.col("announced") + F.col("assigned") == 2) & (F.length(value) >= LEAST_CLEAR)
                                  & (F.col("digits") > 0.1) & (F.col("covered") < 0.3), 1.0))


def injected(found: DataFrame, most: int = INJECTED) -> DataFrame:
    """Up to ``most`` of the findings, the first in hash order, altered, with ``known``: the label that follows from the alteration, or NULL for the rules' own."""
    drawn = F.xxhash64(F.lit("injected"), "doc_id", "position", "part", "value")
    some = found.orderBy(drawn, "doc_id", "position", "part", "value").limit(most).withColumn("seed", F.sha2(F.concat_ws("/", "doc_id", "position", "part", "value"), 256))
    kind = F.pmod(F.xxhash64("seed"), F.lit(4))
    bits = F.regexp_replace(F.base64(F.unhex("seed")), "[^A-Za-z0-9]", "")
    size = F.pmod(F.xxhash64(F.lit("size"), "seed"), F.lit(22)).cast("int") + 18
    key = F.substring(bits, F.lit(1), size)
    public = F.when(F.pmod(F.xxhash64(F.lit("format"), "seed"), F.lit(2)) == 0, F.concat(F.lit("ghp_"), F.substring(bits, 1, 36)))
    public = F.coalesce(public, F.concat(F.lit("AKIA"), F.upper(F.substring(bits, 1, 16))))
    value = F.when(kind == 0, key).when(kind == 1, public).when(kind == 2, F.col("value")).otherwise(F.substring("seed", 1, 40))
    quiet = F.when(F.col("before").rlike(ANNOUNCES) | F.col("name").rlike(ANNOUNCES), F.lit("")).otherwise(F.col("before"))
    return some.select("doc_id", "position", "part", value.alias("value"), F.lit("").alias("name"),
                       F.when(kind == 2, F.lit('password = "')).otherwise(quiet).alias("before"), "after",
                       F.when(kind < 2, 1.0).when(kind == 3, 0.0).alias("known"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> PipelineModel | None:
    """A forest from ``sample`` labelled findings in hash order, half of each kind where there are so many; None if all are of one kind."""
    drawn = F.xxhash64("doc_id", "position", "value")
    chosen = [labelled.where(F.col("label") == k).orderBy(drawn, "doc_id", "position", "value").limit(sample // 2).select(*_FEATURES, "label")
              for k in (0, 1)]
    rows = staged(chosen[0].unionByName(chosen[1]), "secret-sample")
    if rows.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=_FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    minInstancesPerNode=5)
    # One order of the bounded sample, so a repeated run grows the same trees.
    ordered = assembler.transform(rows.coalesce(1).sortWithinPartitions(*_FEATURES, "label"))
    return PipelineModel([assembler, forest.fit(ordered)])


def judge(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``found`` with score (the forest's share of votes for a secret) and is_secret."""
    if model is None:
        return (rule_labels(found).withColumn("score", F.coalesce("label", F.lit(0.5))).withColumn("is_secret", F.coalesce(F.col("label") == 1, F.lit(False)))
                .drop("label"))
    voted = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return (voted.withColumn("is_secret", F.col("score") >= 0.5)
            .drop("vector", "rawPrediction", "probability", "prediction"))


def scan(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per finding: doc_id, position, part, length, value_sha256, announced, score, is_secret.

    ``labels``: checked findings (doc_id, position, label 0 or 1, and part where a word holds several) to train on;
    :func:`rule_labels` without.
    """
    words = staged(dictionary(docs), "secret-dictionary")
    found = staged(findings(docs), "secret-findings")
    if labels is None:
        found = found.withColumn("injected", F.lit(False)).unionByName(injected(found).withColumn("injected", F.lit(True)), allowMissingColumns=True)
    found = staged(features(found, words), "secret-features")
    if labels is None:
        ruled = rule_labels(found)
        # Announced like a password or not: an injected value is what the rules say of values alone.
        labelled = ruled.withColumn("label", F.when(~F.col("injected"), F.col("label")).otherwise(
            F.coalesce("known", F.when(F.col("label") == 0, 0.0))))
        found = found.where("NOT injected")
    else:
        keys = [c for c in ("doc_id", "position", "part") if c != "part" or c in labels.columns]
        labelled = found.join(labels.select(*keys, "label"), keys)
    return judge(found, train(labelled)).select(
        "doc_id", "position", "part", F.col("length").cast("bigint").alias("length"), F.sha2("value", 256).alias("value_sha256"),
        (F.col("announced") == 1).alias("announced"), "score", "is_secret")
