"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines within ``edits`` edits share one of ``edits + 1`` segments of the shorter line: that many edits cannot touch them all. Equal
lines are one class first. Every class is indexed by its segments, keyed by length, number and hash, and probes for the segments of
classes up to ``edits`` shorter. Where a segment may start in the longer line follows from the edits that can lie left and right of it,
which leaves few starts. Classes that meet, and whose letter counts allow so few edits, are verified by edit distance: a bit-parallel column of the ``2 edits + 1`` rows around
the diagonal is carried over the characters, as two integers of vertical differences, so that a pair costs one step a character.
Linked classes form components; the first line of a component by ``doc_id`` and position stays and its other occurrences are repeats.

A hot line is one class before anything is joined, and hot segments are joins that adaptive execution splits. Texts are read
twice; the second time only the lines of candidates are kept, and shuffled.

How many edits two lines may differ by follows from their length: one for every ``PER_EDIT`` characters of the longer one, ``edits`` at most.
Shorter lines are repeats only where they are equal, so that numbers, answers and list marks stay apart. Pairs
of lines too short for all ``edits`` are verified by the plain distance.

Defined results: lines are what ``\\n`` separates; blank lines (white space only) are never compared and stay, and so are lines of fewer than
``min_chars`` characters where a caller asks for that; lines of every length are compared otherwise. Null texts have no
lines, empty texts one. Rows that repeat a ``doc_id`` are one document. The smallest id comes first, null ids after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table, save, save_result
from .components import connected_components

EDITS = 2
PER_EDIT = 10  # characters of the longer line for every edit allowed
EVERY = 1  # bound that compares all lines but blank ones
BROADCAST_LINES = 200_000  # candidate lines up to which their hashes (8 bytes each) are sent to every task
BROADCAST_POSITIONS = 1_000_000  # repeated lines up to which they are sent to every task, so that no whole text is shuffled


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, line`` of every line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def compared(min_chars: int) -> Column:
    """Whether ``line`` takes part: it is long enough and not blank."""
    return (F.length("line") >= min_chars) & F.col("line").rlike(r"\S")


def _keys(line: str) -> list[Column]:
    return [F.xxhash64(F.lit(s), line).alias(f"h{s}") for s in (1, 2)]


def segment_hashes(line: Column, length: Column, edits: int) -> list[Column]:
    """Hashes of the substrings of a line that can equal a segment of a line 0 to ``edits`` shorter; its own segments come first."""
    own, other = [], []
    for shorter in range(edits + 1):
        size = length - shorter
        short = F.floor(size / (edits + 1))
        longer = size - short * (edits + 1)  # so many of the last segments have one character more
        for i in range(1, edits + 2):
            extra = F.greatest(F.lit(0), longer - (edits + 1 - (i - 1)))  # longer ones before segment i
            start = short * (i - 1) + extra + 1
            width = short + F.when(longer >= edits + 2 - i, 1).otherwise(0)
            low = max(-(i - 1), shorter - (edits + 1 - i))
            high = min(i - 1, shorter + (edits + 1 - i))
            for move in range(low, high + 1):
                h = F.xxhash64(F.lit(i), size, F.substring(line, (start + move).cast("int"), width.cast("int")))
                (own if shorter == 0 and move == 0 else other).append(h)
    return own + other


def edit_distance_step(a: Column, m: Column, b: Column, edits: int):
    """One column of the banded bit-parallel edit distance; ``a`` and ``b`` are arrays of characters, ``m`` the size of ``a``.

    Bit ``k`` stands for row ``j - edits + k`` in column ``j``. The state holds the rows where the distance rises (``vp``) and falls
    (``vn``) from the row above, and the distance at the last row of the band or, near the end, of ``a``.
    """
    band = (1 << (2 * edits + 1)) - 1
    zero = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))

    def bit(word: Column, k: Column) -> Column:
        return F.call_function("getbit", word, k)

    def step(s: Column, j: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        char = F.get(b, j - 1)
        match = F.lit(0)
        for k in range(2 * edits + 1):
            match = match + F.when(F.get(a, j - 1 - edits + k) == char, 1 << k).otherwise(0)

        def with_match(x: Column) -> Column:
            d0 = (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(band))
            return F.get(F.transform(F.array(d0), with_d0), F.lit(0))

        def with_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.lit(band) - d0.bitwiseOR(vp))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            row = m - j + edits
            change = F.when(j <= m - edits, 1 - bit(d0, F.lit(2 * edits))).otherwise(bit(hp, row) - bit(hn, row)).cast("int")
            return F.struct(
                hn.bitwiseOR(F.lit(band) - down.bitwiseOR(hp)).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + change).alias("d")
            )

        return F.get(F.transform(F.array(match), with_match), F.lit(0))

    return zero, step


def within_edits(a: str, b: str, edits: int) -> Column:
    """Whether two text columns, the longer one first, are within ``edits`` edits."""
    def distance(s: Column) -> Column:
        zero, step = edit_distance_step(s["a"], F.size(s["a"]), s["b"], edits)
        return F.aggregate(F.sequence(F.lit(1), F.size(s["b"])), zero, step, lambda end: end["d"])

    chars = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    found = F.get(F.transform(F.array(chars), distance), F.lit(0))  # a lambda splits each line once, not once a step
    short = F.least(F.length(a), F.length(b)) <= 2 * edits  # the band would not fit into the line
    near = F.when(short, F.levenshtein(a, b) <= edits).otherwise(found <= edits)
    return F.when(F.abs(F.length(a) - F.length(b)) <= edits, near).otherwise(F.lit(False))


def near(a: str, b: str, edits: int) -> Column:
    """Whether two text columns, the longer one first, differ by no more edits than their length allows."""
    allowed = F.floor(F.length(a) / PER_EDIT)
    return F.when(allowed < edits, F.levenshtein(a, b) <= allowed).otherwise(within_edits(a, b, edits))


LETTERS = "abcdefghijklmnopqrstuvwxyz"
COUNTED = "eaitsnorulcdmpghbfvyqwkxjz"  # modulo 4 in the marks of a line; common ones first, as each is taken out before the next is counted


def letter_marks(line: Column) -> Column:
    """Counts of letters modulo 4, two bits each: an edit moves at most two of them, by one."""
    def marks(s: Column) -> Column:  # with the letter that was taken out last
        return s["marks"] * 4 + F.pmod(s["size"] - F.octet_length(s["rest"]), F.lit(4))

    def without(s: Column, letter: Column) -> Column:
        rest = F.replace(s["rest"], letter, F.lit(""))
        return F.struct(rest.alias("rest"), F.octet_length(s["rest"]).alias("size"), marks(s).alias("marks"))

    whole = F.struct(line.alias("rest"), F.octet_length(line).alias("size"), F.lit(0).cast("long").alias("marks"))
    return F.aggregate(F.array(*map(F.lit, COUNTED)), whole, without, marks)


def marks_within(a: str, b: str, edits: int) -> Column:
    """Whether the marks of two lines allow that few edits."""
    apart = F.lit(0)
    for k in range(len(LETTERS)):
        d = (F.shiftright(a, 2 * k) - F.shiftright(b, 2 * k)).bitwiseAND(F.lit(3))
        apart = apart + F.least(d, F.lit(4) - d)
    return apart <= 2 * edits


def line_classes(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """One row per distinct compared line: ``h1, h2, first, n, marks, probes``."""
    rows = lines_of(docs).filter(compared(min_chars)).withColumn("length", F.length("line"))
    probes = F.array(*segment_hashes(F.col("line"), F.col("length"), edits))
    # A line that no other one of an allowed length can be near to has no probes.
    probes = F.when(F.col("length") >= PER_EDIT - 1, probes).otherwise(F.array().cast("array<bigint>")).alias("probes")
    rows = rows.select(*_keys("line"), letter_marks(F.col("line")).alias("marks"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos").alias("at"), probes)
    return rows.groupBy("h1", "h2").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.first("marks").alias("marks"), F.first("probes").alias("probes")
    )


def candidate_pairs(classes: DataFrame, edits: int) -> DataFrame:
    """``a, b``: hashes of classes that share a segment and whose letters allow so few edits, the longer line first."""
    index = classes.select(F.col("h1").alias("b"), F.col("marks").alias("mb"), F.explode(F.slice("probes", 1, edits + 1)).alias("s"))
    probe = classes.select(F.col("h1").alias("a"), F.col("marks").alias("ma"), F.posexplode("probes").alias("k", "t"))
    probe = probe.select("a", "ma", "t", (F.col("k") < edits + 1 + _moved(edits)).alias("level"))
    # Lines of one length meet both ways; one way is enough.
    met = index.join(probe, F.col("s") == F.col("t")).filter("a <> b and (not level or a > b)")
    return met.filter(marks_within("ma", "mb", edits)).select("a", "b").distinct()


def _moved(edits: int) -> int:
    """Probes for lines of the same length besides the own segments."""
    return sum(2 * min(i - 1, edits + 1 - i) for i in range(1, edits + 2))


def near_links(docs: DataFrame, classes: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``a, b``: verified links between classes."""
    pairs = save(candidate_pairs(classes, edits), "line-pairs")
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), "line-ids")
    few = wanted.count() <= BROADCAST_LINES
    rows = lines_of(docs).filter(compared(min_chars)).select(*_keys("line"), "line")
    texts = rows.join(F.broadcast(wanted) if few else wanted, F.col("h1") == F.col("w"), "left_semi").dropDuplicates(["h1", "h2"])
    texts = save(texts.select("h1", "line"), "line-texts")
    left = pairs.join(texts.select(F.col("h1").alias("a"), F.col("line").alias("la")), "a")
    both = left.join(texts.select(F.col("h1").alias("b"), F.col("line").alias("lb")), "b")
    # Few bytes but long work: not to be put together into few tasks again.
    both = both.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    return both.filter(near("la", "lb", edits)).select("a", "b").distinct()


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = EVERY) -> DataFrame:
    """``doc_id, pos`` of every line of which an equal or near-equal line stands earlier."""
    return kept_elsewhere(docs, edits, min_chars).select("doc_id", "pos")


def kept_elsewhere(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``doc_id, pos, length, home`` of every repeated line: its characters and the document where the line that stays stands."""
    docs = docs.select("doc_id", "text")
    classes = save(line_classes(docs, edits, min_chars), "lines")
    links = save_result(docs.sparkSession, lambda: near_links(docs, classes, edits, min_chars), "links")
    comps = save_result(docs.sparkSession, lambda: connected_components(links, "a", "b"), "line-components")
    known = classes.select("h1", "h2", "first", "n").join(comps, F.col("h1") == F.col("node"), "left")
    keepers = known.filter("component_id is not null").groupBy("component_id").agg(F.min("first").alias("keeper"))
    single = known.filter("component_id is null and n > 1").select("h1", "h2", F.col("first").alias("keeper"))
    linked = known.filter("component_id is not null").select("h1", "h2", "component_id").join(keepers, "component_id")
    decided = single.unionByName(linked.select("h1", "h2", "keeper"))
    decided = decided.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("keeper.doc_id").alias("kd"), F.col("keeper.pos").alias("kp"))
    rows = lines_of(docs).filter(compared(min_chars)).select("doc_id", "pos", F.length("line").alias("length"), *_keys("line"))
    met = rows.join(decided, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    stays = F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("pos") == F.col("kp"))
    return met.filter(~stays).select("doc_id", "pos", "length", F.col("kd").alias("home"))


def line_report(docs: DataFrame, edits: int = EDITS, min_chars: int = EVERY) -> DataFrame:
    """``doc_id, n_lines, n_repeated, repeated`` (positions in order) for every row of ``docs(doc_id, text)``."""
    found = repeated_lines(docs, edits, min_chars).distinct().groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list("pos")).alias("repeated"))
    rows = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<int>")
    return joined.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("repeated"), F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("repeated", none).alias("repeated"),
    )


def _shingles(text: str, width: int) -> Column:
    """Distinct hashes of ``width`` words in a row; shorter texts have one for all their words."""
    words = F.split(F.translate(text, LETTERS.upper(), LETTERS), r"[\x20\x09-\x0D]+")

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(F.get(F.transform(F.array(F.filter(words, lambda w: w != "")), hashes), F.lit(0)))


def _cleaned(text: str, gone: str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")


def shown_copies(docs: DataFrame, found: DataFrame, gone: DataFrame, copy_share: float, width: int, percent: int) -> DataFrame:
    """``copy``: documents that stay whole because the next stage drops them.

    ``copy_share`` or more of the characters are repeated lines, and the whole text has a Jaccard similarity of ``percent`` with what is
    left of the document in which most of these lines stay; that one is not such a document itself.
    """
    sizes = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("size"))
    shares = found.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("n"))
    mostly = shares.join(sizes, F.col("doc_id") == F.col("_id")).filter(F.col("size") - F.col("chars") - F.col("n") <= F.col("size") * (1 - copy_share))
    mostly = save(mostly.select("_id"), "mostly-repeated")
    homes = found.join(mostly, F.col("doc_id") == F.col("_id")).groupBy("_id", "home").agg(F.sum("length").alias("chars"))
    best = homes.groupBy("_id").agg(F.min(F.struct((-F.col("chars")).alias("c"), "home")).alias("p")).select(F.col("_id").alias("copy"), "p.home")
    pairs = save(best.filter("copy <> home").join(mostly, F.col("home") == F.col("_id"), "left_anti"), "copies-of")

    def sets(ids: str, text: str | Column, rows: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col(ids).alias("_w")).distinct()
        return rows.join(wanted, F.col("doc_id") == F.col("_w")).select(F.col("_w").alias(ids), text)

    home = sets("home", "text", docs).join(gone, F.col("home") == F.col("_id"), "left")
    home = home.select("home", F.when(F.col("_gone").isNotNull(), _cleaned("text", "_gone")).otherwise(F.col("text")).alias("text"))
    x = sets("copy", "text", docs).select("copy", _shingles("text", width).alias("x"))
    y = home.select("home", _shingles("text", width).alias("y"))
    both = pairs.join(x, "copy").join(y, "home").withColumn("same", F.size(F.array_intersect("x", "y")))
    near = (F.col("same") > 0) & (100 * F.col("same") >= percent * (F.size("x") + F.size("y") - F.col("same")))
    # Of rows that repeat an id, all must be copies.
    return save(both.groupBy("copy").agg(F.every(near).alias("near")).filter("near").select("copy"), "shown-copies")


def without_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = EVERY, copy_share: float = 0.5, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts; ``n_chars`` follows where the frame has it.

    Only a document that :func:`shown_copies` finds to be a copy stays whole, for a comparison of documents on ``width`` and ``percent`` to
    drop. Other columns, null texts and rows without repeats are unchanged; rows without an id neither count nor change.
    """
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    found = save_result(docs.sparkSession, lambda: kept_elsewhere(known, edits, min_chars).distinct(), "kept-elsewhere")
    gone = save(found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("_gone")), "repeated")
    copies = shown_copies(known, found, gone, copy_share, width, percent)
    gone = gone.join(copies, F.col("_id") == F.col("copy"), "left_anti")
    gone = save(gone, "taken-out")
    few = gone.agg(F.coalesce(F.sum(F.size("_gone") + 1), F.lit(0))).first()[0] <= BROADCAST_POSITIONS
    joined = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_id"), "left")
    text = F.when(F.col("_gone").isNotNull() & F.col("text").isNotNull(), _cleaned("text", "_gone")).otherwise(F.col("text"))
    out = joined.withColumn("text", text).drop("_gone", "_id")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op9_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of ``documents`` but blank ones, at one edit for every ten characters, two at most."""
    return line_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=EVERY)
