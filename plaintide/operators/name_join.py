"""Similarity join of names by the character score, by equi-joins alone.

A word that few names of the right have (``RARE`` at most) is rare. All pairs with a rare word in
common are listed by a join on it; they are as many as the left has words, times ``RARE`` at most.

The other pairs have only common words in common. A name falls into a class: its common words, and
the shapes of the rest (digits made 0). What two names without a common rare word have in
common follows from their classes, so classes are compared instead of names:

* ``covered``: the score by the words in common. It is that of every such pair of the classes.
* ``edited``: the most that few insertions and deletions can give. Letters kept are in both
  names, and a bigram of a name lies in one word with its blanks, whatever the order of the words,
  and an edit touches at most two.

Only members of classes where one of both reaches the floor are paired. Where ``covered`` is the higher
one, it is the score, and nothing is computed for a pair. No pair above the floor is lost and none below it
is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.operators.similarity import class_score_bound, pair_blocks, pair_score
from plaintide.session import settle

#: A key is repeated this often on the right, so that a frequent one spreads over as many tasks.
SALTS = 8
#: Names that are compared at a time, of the left and of the right.
BLOCKS = (64, 256)
#: Names of the right that may have a rare word.
RARE = 32
#: Mark of the shape of a word that is not common.
SHAPE = "\x01"


def _words(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != "")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once and not in each step of a lambda of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(items: Column) -> Column:
    """One or two letters as a number, with the count of equal ones before: a repeated one is counted on."""

    def counted(ordered: Column) -> Column:
        def code(g: Column, i: Column) -> Column:
            letters = F.ascii(g).cast("long") * (1 << 33) + F.ascii(F.substring(g, F.length(g), F.lit(1))).cast("long") * (1 << 12)
            return letters + i + 1 - F.array_position(ordered, g)

        return F.transform(ordered, code)

    return _once(F.array_sort(items), counted)


def _pieces(text: Column, size: int) -> Column:
    def cut(whole: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(whole) - (size - 1))
        return F.transform(places, lambda i: F.substring(whole, i, F.lit(size)))

    return _once(text, cut)


def coded(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' distinct names (name, klass, rare), written once."""
    words = [side.select("name", F.explode(_words(F.col("name"))).alias("word")) for side in (left, right)]
    frequency = settle(words[1].groupBy("word").agg(F.count("*").alias("df")), "word-frequency")
    common = F.col("df") > RARE
    shape = F.concat(F.lit(SHAPE), F.regexp_replace("word", "[0-9]", "0"))
    sides = []
    for side in words:
        found = side.join(frequency, "word", "left").groupBy("name").agg(
            F.array_join(F.array_sort(F.collect_list(F.when(common, F.col("word")).otherwise(shape))), " ").alias("klass"),
            F.collect_list(F.when(F.col("df") <= RARE, F.col("word"))).alias("rare"),
        )
        sides.append(settle(found, "coded-names"))
    return sides[0], sides[1]


def rare_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_name, right_name) of all pairs of coded names with a rare word in common."""
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    own = left.select(
        F.col("name").alias("left_name"), F.explode("rare").alias("word"), F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int").alias("salt")
    )
    other = right.select(F.col("name").alias("right_name"), F.explode("rare").alias("word")).withColumn("salt", F.explode(salts))
    return own.join(other, ["word", "salt"]).select("left_name", "right_name").distinct()


def classes_of(names: DataFrame) -> DataFrame:
    """The classes of coded names: ``common`` words, ``shapes``, length, letters, bigrams and the first name."""
    parts = F.split("klass", " ")
    # Digits are one letter in all words, as one of a common word may be kept for one of a shape.
    text = F.replace(F.regexp_replace("klass", "[0-9]", "0"), F.lit(SHAPE), F.lit(""))
    found = names.groupBy("klass").agg(F.min("name").alias("first")).select(
        "klass",
        "first",
        F.filter(parts, lambda w: ~w.startswith(SHAPE)).alias("common"),
        F.transform(F.filter(parts, lambda w: w.startswith(SHAPE)), lambda w: F.substring(w, F.lit(2), F.length(w))).alias("shapes"),
        F.length(text).alias("n"),
        _numbered(_pieces(text, 1)).alias("letters"),
        _numbered(_pieces(F.concat(F.lit(" "), text, F.lit(" ")), 2)).alias("grams"),
    )
    return settle(found, "classes")


def _weight(words: Column) -> Column:
    """Letters of the words and a blank after each."""
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w) + 1)


def _first_words(side: DataFrame, other: DataFrame, share: float) -> DataFrame:
    """The words (klass, word) of a class up to which it still has enough weight, from rare to common."""
    words = side.select("klass", "n", F.explode("common").alias("word"))
    words = words.join(other.select(F.explode("common").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "word")
    rest = Window.partitionBy("klass").orderBy(F.desc("df"), F.desc("word")).rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum(F.length("word") + 1).over(rest)
    needed = share * (F.col("n") + 1) + (1.0 - share)
    return words.withColumn("_left", left).where(F.col("_left") >= needed - 1e-9).select("klass", "word")


def _covered(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Pairs of classes whose common words make up the share of one name's letters that the floor asks for.

    With ``c`` letters in common words, the score of a name of ``n`` letters (blanks
    between words count) is ``100 - 100 (n - c) / (n + c)``, or 100 where all words are common.
    """
    share = floor / (200.0 - floor)
    found = []
    for mine, theirs in ((left, right), (right, left)):
        first, every = _first_words(mine, theirs, share), theirs.select("klass", F.explode("common").alias("word"))
        own, other = (first, every) if mine is left else (every, first)
        pairs = own.withColumnRenamed("klass", "left_class").join(other.withColumnRenamed("klass", "right_class"), "word")
        found.append(pairs.select("left_class", "right_class"))
    return found[0].union(found[1])


def _edited(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Pairs of classes with so many letters in common that insertions and deletions may be few enough."""
    shortest = floor / (200.0 - floor)  # the shorter length as a share of the longer
    lengths = F.sequence(F.ceil(F.col("n") * shortest - 1e-9).cast("int"), F.floor(F.col("n") / shortest + 1e-9).cast("int"))
    own = left.select(F.col("klass").alias("left_class"), F.col("letters").alias("_l"), F.col("n").alias("_n"), F.explode(lengths).alias("n"))
    other = right.select(F.col("klass").alias("right_class"), F.col("letters").alias("_r"), "n")
    kept = F.size(F.array_intersect("_l", "_r"))
    return own.join(other, "n").where(kept >= floor / 200.0 * (F.col("_n") + F.col("n")) - 1e-9).select("left_class", "right_class")


def weighed(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of classes with ``covered``, the score by common words, and ``most``, which no score of theirs exceeds."""
    l, r = (side.select(*[F.col(c).alias(f"{x}_{c}") for c in side.columns if c != "klass"], F.col("klass").alias(f"{x}_class")) for side, x in ((left, "left"), (right, "right")))
    joined = pairs.distinct().join(l, "left_class").join(r, "right_class")
    shared = F.array_intersect("left_common", "right_common")
    total = F.col("left_n") + F.col("right_n")
    c = _weight(shared) - 1

    def by_words(n: Column) -> Column:
        return 100.0 - 100.0 * (n - c).cast("double") / (n + c).cast("double")

    letters = 200.0 * F.size(F.array_intersect("left_letters", "right_letters")) / total
    grams = 100.0 * (F.size(F.array_intersect("left_grams", "right_grams")) - 1 + total) / (1.5 * total)
    covered = F.when(F.size(shared) > 0, F.greatest(by_words(F.col("left_n")), by_words(F.col("right_n")))).otherwise(0.0)
    return joined.withColumn("covered", covered).withColumn("edited", F.least(letters, grams) + 1e-9).withColumn(
        "most", F.greatest("covered", "edited")
    )


def tightened(pairs: DataFrame) -> DataFrame:
    """Weighed pairs with ``edited`` and ``most`` by the order of letters too; for those few that the counts of letters leave."""
    bound = class_score_bound("left_common", "left_shapes", "right_common", "right_shapes") + 1e-9
    return pairs.withColumn("edited", F.least("edited", bound)).withColumn("most", F.greatest("covered", "edited"))


def near_classes(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(left_class, right_class) of all classes some names of which may reach the floor; holds others."""
    return _covered(left, right, floor).union(_edited(left, right, floor))


def members(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names of paired classes without a rare word in common.

    ``left`` has left_name, rare, right_class and columns of its own, which stay; ``right`` are coded names. Both sides are
    small and their pairs many, so the number of partitions is stated and adaptive execution does not lower it.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("left_name"), F.lit(SALTS)).cast("int")
    other = right.select(
        F.col("name").alias("right_name"), F.col("klass").alias("right_class"), F.col("rare").alias("_rare"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    sides = (side.repartition(parts, "right_class", "salt") for side in (left.withColumn("salt", salt), other))
    joined = next(sides).join(next(sides), ["right_class", "salt"]).where(~F.arrays_overlap("rare", "_rare"))
    return joined.drop("salt", "rare", "_rare")


def named(df: DataFrame) -> DataFrame:
    return df.where(F.trim("name") != "").select("name").distinct()


def near_class_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Weighed pairs of classes some names of which may reach the floor."""
    if not 3 * floor > 200:
        raise ValueError("the floor must be above 66.7")
    return weighed(near_classes(left, right, floor), left, right).where(F.col("most") >= floor - 1e-9)


def similar_members(
    pairs: DataFrame, left: DataFrame, right: DataFrame, floor: float, carried: list[str], shown: Callable[[Column], Column] = lambda score: score
) -> DataFrame:
    """(label, right_name, carried columns, score) of all names of weighed pairs of classes with at least the floor and no rare word in common.

    ``left`` are coded names with a ``label``. A class of the right meets those of the left together that have the same words in
    common with it and the same length; names are compared block by block. The score follows from the number of
    edits, so the scores of blocks, as ``shown``, are listed before their names are paired.
    """
    shared, by_words = F.array_intersect("left_common", "right_common"), F.col("edited") < F.col("covered")
    pairs = pairs.select(
        "left_class", "right_class", *carried, shared.alias("common"), by_words.alias("by_words"), "covered", (F.col("left_n") + F.col("right_n")).alias("total")
    )
    pairs = settle(pairs, "class-pairs")
    alike = ["right_class", *carried, "common", "by_words", "covered", "total"]
    sizes = left.groupBy(F.col("klass").alias("left_class")).agg(F.count("*").alias("_n"))
    blocks = F.ceil(F.sum("_n").over(Window.partitionBy(*alike)) / BLOCKS[0])
    met = pairs.join(sizes, "left_class").withColumn("_blocks", blocks).join(left.withColumnRenamed("klass", "left_class"), "left_class")
    met = met.groupBy(*alike, F.pmod(F.xxhash64("name"), F.col("_blocks")).alias("_part")).agg(F.collect_list(F.struct("label", "name", "rare")).alias("_lefts"))

    counts = right.groupBy("klass").agg(F.ceil(F.count("*") / BLOCKS[1]).alias("_blocks"))
    other = right.join(counts, "klass").withColumn("block", F.pmod(F.xxhash64("name"), F.col("_blocks")))
    other = other.groupBy(F.col("klass").alias("right_class"), "block").agg(F.collect_list(F.struct("name", "rare")).alias("_rights"))
    other = settle(other, "right-blocks")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Blocks are few and their pairs many, so the number of partitions is stated and adaptive execution does not lower it.
    met = met.join(other.select("right_class", "block"), "right_class").repartition(parts, "right_class", "block")
    met = met.join(other.repartition(parts, "right_class", "block"), ["right_class", "block"])

    total, most = F.col("total"), F.floor((100.0 - floor) / 100.0 * F.col("total") + 1e-9).cast("int") + 1

    def score(edits: Column) -> Column:
        likeness = F.greatest(F.col("covered"), 100.0 - 100.0 * edits.cast("double") / total.cast("double"))
        return F.when(likeness >= floor, shown(likeness))

    # Where the words decide, the edits count as 0 and the only score is that by words.
    edited = F.transform(F.sequence(F.lit(0), most), score)
    scores = F.when(F.col("by_words"), F.array(F.when(F.col("covered") >= floor, shown(F.col("covered"))))).otherwise(edited)
    met = met.select(
        *carried, scores.alias("scores"), F.col("_lefts.label").alias("labels"), F.col("_lefts.name").alias("lefts"), F.col("_lefts.rare").alias("left_rares"),
        F.col("_rights.name").alias("rights"), F.col("_rights.rare").alias("right_rares"), "common", "by_words", most.alias("most"),
        (F.col("covered") >= floor).alias("covers"),
    )
    kept = [met.schema[c] for c in (*carried, "scores", "labels", "rights")]
    found = met.mapInArrow(pair_blocks, T.StructType([*kept, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("pairs", "edits"))]))
    each = found.select("*", F.posexplode("pairs").alias("_at", "_pair"))
    wide = F.size("labels")
    each = each.select(
        F.get("labels", F.col("_pair") % wide).alias("label"),
        F.get("rights", F.floor(F.col("_pair") / wide).cast("int")).alias("right_name"),
        *carried,
        F.get("scores", F.get("edits", F.col("_at"))).alias("score"),
    )
    return each.where("score IS NOT NULL")


def similar_names(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(left_name, right_name, score) of all pairs with at least the floor; both sides have a column ``name``.

    The floor is above 66.7; below it no number of common bigrams follows. Names without words are left out.
    """
    if not 3 * floor > 200:
        raise ValueError("the floor must be above 66.7")
    left, right = coded(named(left), named(right))
    pairs = near_class_pairs(classes_of(left), classes_of(right), floor)
    same = similar_members(pairs, left.withColumn("label", F.col("name")), right, floor, [])
    scored = rare_pairs(left, right).withColumn("score", pair_score("left_name", "right_name"))
    return same.withColumnRenamed("label", "left_name").union(scored.where(F.col("score") >= floor))
