"""Fuzzy line dedup: SimHash of normalised lines, joined on pigeonhole blocks, verified by edit similarity; one occurrence
of each connected group of lines is kept. DataFrame functions only.

A line's SimHash is taken a part of the line at a time: its words are cut into four runs, and each run gives one block of 16
bits. A changed word alters one block only, so lines with changes in at most two of the four runs agree in at least two
blocks, the pigeonhole's, whatever bits of the others differ.
"""

from __future__ import annotations

from itertools import combinations
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ROW, discard, materialize, packed, skew_join, unpacked, with_row_id
from tickloom.llm.components import connected_components

LANE_WORDS, LANE_MOST = 60_000, 127  # words of a line counted together: as many as asked for, no more than a lane can count
EACH = 0x0001_0001_0001_0001
BLOCKS = 4
CLOSE_BANDS = (128, 2048)
#: What becomes one space, line feeds aside: all between letters but a lone space, which may stay. Letters a to z are told first.
BETWEEN = r"[^a-z\n\p{L}](?:[^a-z\n\p{L}]++|(?<! ))".replace("a-z", ascii_lowercase)


def normalised(line: Column) -> Column:
    """Lower-case letters; all between them, digits too, as one space."""
    return F.trim(F.regexp_replace(F.lower(line), BETWEEN, " "))


def long_(x: int) -> Column:
    return F.lit(x).cast("long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_mask(block: int) -> int:
    """The 16 bits of a block: four neighbouring lanes."""
    return sum(EACH << i for i in range(4 * block, 4 * block + 4))


def grouped_simhash(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp, a 64-bit SimHash of four blocks: a bit of block b is 1 if over half of the words of the b-th quarter of the
    line have it in their XXH64.

    words: keys, pos, w, and n, the number of the line's words. A long holds eight counters in lanes of 8 bits, so two sums
    count the 16 bits of a quarter's block over LANE_MOST words at most; such parts come together in lanes of 32 bits. With
    2**30 less the majority added to each of these, bit 30 tells where a majority was reached.
    """
    at, size = F.expr(f"CAST(pos * {BLOCKS} div n AS INT)"), min(LANE_WORDS, LANE_MOST)
    hashed = words.select(*keys, (F.expr(f"CAST(pos div {size} AS INT)") * BLOCKS + at).alias("part"), F.xxhash64("w").alias("x"), at.alias("q"))
    lane = lambda j: F.expr(f"(shiftrightunsigned(x, 4 * q + {2 * j}) & {EACH}L) | shiftleft(shiftrightunsigned(x, 4 * q + {2 * j + 1}) & {EACH}L, 8)")
    parts = hashed.groupBy(*keys, "part").agg(F.count("*").alias("n"), *[F.sum(lane(j)).alias(f"s{j}") for j in (0, 1)])
    wide = {(j, h): F.shiftrightunsigned(f"s{j}", 8 * h).bitwiseAND(long_(0x0000_00FF_0000_00FF)) for j in (0, 1) for h in range(4)}
    sums = parts.groupBy(*keys, F.pmod("part", F.lit(BLOCKS)).alias("q")).agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"w{j}_{h}") for (j, h), c in wide.items()])
    bias = (long_(1 << 30) - (F.expr("n div 2") + 1)) * long_(0x0000_0001_0000_0001)
    block = long_(0)
    for j, h in wide:  # lanes h and h + 4 of a sum: bits 2j or 2j + 1 of each 16, in turn
        reached = F.shiftrightunsigned((F.col(f"w{j}_{h}") + bias).bitwiseAND(long_(0x4000_0000_4000_0000)), 30)
        block = block.bitwiseOR(F.shiftleft(reached, 2 * j + h % 2 + 16 * (h // 2)))
    return sums.select(*keys, "q", block.alias("block")).groupBy(*keys).agg(F.bit_or(F.expr("shiftleft(block, 4 * q)")).alias("fp"))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line of at least min_chars normalised characters: where it stands, two hashes and its normalised form.
    A text is normalised whole, its line feeds kept; only its ends are trimmed line by line. Single spaces stay as they are, so
    most words cost no replacement."""
    forms = F.regexp_replace(F.lower("text"), BETWEEN, " ")
    lines = docs.select("doc_id", ROW, F.posexplode(F.split(forms, "\n")).alias("ln", "line"))
    once = lines.select("doc_id", ROW, "ln", F.trim("line").alias("norm")).filter(F.length("norm") >= min_chars)
    return once.select("doc_id", ROW, "ln", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), "norm")


def distinct_lines(rows: DataFrame) -> DataFrame:
    """lid, h1, h2, n, fp, doc_id, row and ln of the first occurrence, for each distinct line. Lines meet once, with their texts;
    fingerprints are then summed where the lines are. Lines of fewer than BLOCKS words are taken letter by letter."""
    order = F.struct("doc_id", ROW, "ln")
    lines = rows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("many"), F.min("norm").alias("norm"))
    keys = ["h1", "h2", "many", "doc_id", ROW, "ln"]
    cut = lines.select("h1", "h2", "many", "first.*", "norm", F.split("norm", " ").alias("words"))
    split = cut.select(*keys, F.explode(F.array(F.when(F.size("words") >= BLOCKS, F.col("words")).otherwise(F.split("norm", "")))).alias("words"))
    prints = grouped_simhash(split.select(*keys, F.size("words").alias("n"), F.posexplode("words").alias("pos", "w")), keys)
    return prints.withColumn("lid", F.monotonically_increasing_id())


def choices_of(changed: int) -> list[int]:
    """Masks, as signed longs, of each choice of BLOCKS - changed blocks: values that differ in at most `changed` blocks agree in
    all bits of at least one choice."""
    return [signed(sum(block_mask(b) for b in c)) for c in combinations(range(BLOCKS), BLOCKS - changed)]


def crowded(lines: DataFrame, masks: list[int]) -> DataFrame:
    """(lid, key, head) for each line and choice of blocks that it shares with another line; key stands for the choice and its
    bits, head is the smallest line there. Copies are one line here, so a frequent line is met once."""
    keyed = lines.select("lid", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(long_(m))) for i, m in enumerate(masks)])).alias("key"))
    heads = materialize(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("lid").alias("head")).filter("n > 1").drop("n"))
    return skew_join(keyed, heads.hint("shuffle_hash"), ["key"])


def texts_of(met: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(lid, norm) of the lines that meet any other. Their documents are read once more, each cut into its lines once."""
    wanted = met.select("lid").distinct().join(lines.select("lid", ROW, "ln"), "lid")
    places = wanted.groupBy(ROW).agg(F.collect_list(F.struct("ln", "lid")).alias("places"))
    cut = docs.select(ROW, "text").join(places, ROW).select("places", F.explode(F.array(F.split("text", "\n"))).alias("all"))
    return cut.select("all", F.inline("places")).select("lid", normalised(F.col("all")[F.col("ln")]).alias("norm"))


def same_from_start(a: Column, b: Column) -> Column:
    """How many words two lists have alike before the first that differs."""
    return F.array_position(F.concat(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.array(F.lit(False))), False).cast("int") - 1


def word_by_word(a: Column, b: Column) -> Column:
    """Letters that turn one list of words into the other if each word is turned into the one at its place; words beyond the shorter
    list count with their space. No edit distance of the lines is greater."""
    letters = lambda x, y: F.when(x.isNull(), F.length(y) + 1).when(y.isNull(), F.length(x) + 1).when(x == y, 0).otherwise(F.levenshtein(x, y))
    return F.aggregate(F.zip_with(a, b, letters), F.lit(0), lambda total, n: total + n)


def word_after_word(a: Column, b: Column) -> Column:
    """As word_by_word, but a word that one of the next two of the other list equals waits for it, and those before that one go, each with its
    space. So words put in or left out don't move all that follow."""

    def step(t: Column, _: Column) -> Column:
        (x, x1, x2), (y, y1, y2) = ([F.get(w, at + k) for k in range(3)] for w, at in ((a, t.i), (b, t.j)))
        to = lambda i, j, letters: F.struct((t.i + i).alias("i"), (t.j + j).alias("j"), (t.n + letters).alias("n"))
        turned = F.when(x.isNull() & y.isNull(), t).when(x == y, to(1, 1, 0))
        turned = turned.when(y.isNull() | (x1 == y), to(1, 0, F.length(x) + 1)).when(x.isNull() | (x == y1), to(0, 1, F.length(y) + 1))
        turned = turned.when(x1 == y1, to(1, 1, F.levenshtein(x, y))).when(x2 == y, to(1, 0, F.length(x) + 1)).when(x == y2, to(0, 1, F.length(y) + 1))
        return turned.otherwise(to(1, 1, F.levenshtein(x, y)))

    start = F.struct(*[F.lit(0).alias(c) for c in ("i", "j", "n")])
    return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, step, lambda t: t.n)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later ones and filters name them."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose lines have edit similarity 1 - distance / longer length, in letters, of at least `similarity`.

    The words that both lines begin and end with are left out, which leaves the distance as it is. What remains is first turned word
    by word, then with words put in or left out: where that takes no more letters than allowed, the lines are alike. Only the others
    are compared as strings.
    """
    side = lambda e: texts.withColumnRenamed("norm", f"t{e}")
    both = skew_join(skew_join(pairs.withColumn("lid", F.col("b")), side("b"), ["lid"]).withColumn("lid", F.col("a")), side("a"), ["lid"])
    la, lb = F.length("ta"), F.length("tb")
    allowed = F.floor((1 - F.lit(similarity)) * F.greatest(la, lb) + 1e-9).cast("int")
    cut = held(both.filter(F.abs(la - lb) <= allowed), allowed=allowed, wa=F.split("ta", " "), wb=F.split("tb", " ")).drop("ta", "tb")
    ends = held(cut, before=same_from_start(F.col("wa"), F.col("wb")), after=same_from_start(F.reverse("wa"), F.reverse("wb")))
    after = F.least("after", F.least(F.size("wa"), F.size("wb")) - F.col("before"))
    middle = lambda w: F.slice(w, F.col("before") + 1, F.size(w) - F.col("before") - after)
    left = held(ends, wa=middle("wa"), wb=middle("wb"))
    turned = held(left, most=word_by_word(F.col("wa"), F.col("wb")))
    most = held(turned, most=F.when(F.col("most") <= F.col("allowed"), F.col("most")).otherwise(word_after_word(F.col("wa"), F.col("wb"))))
    spaced = lambda w: F.when((F.col("most") > F.col("allowed")) & (F.size(w) > 0), F.concat(F.array_join(w, " "), F.lit(" "))).otherwise("")
    asked = held(most, ta=spaced("wa"), tb=spaced("wb"))
    within = lambda n: F.call_function("levenshtein", F.col("ta"), F.col("tb"), n) >= 0
    close = within(F.col("allowed"))
    for band in reversed(CLOSE_BANDS):  # a narrow band tells long lines at less work
        close = ((F.col("allowed") > 4 * band) & within(F.lit(band))) | close
    return asked.filter((F.col("most") <= F.col("allowed")) | close).select("a", "b")


def grouped(met: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the keys whose lines are in more than one group: (key, lid, g), and (key, main, lead, many): the key's largest group, its
    smallest line, and the number of pairs of lines to compare there."""
    known = materialize(skew_join(met.select("lid", "key"), groups.withColumnRenamed("node", "lid"), ["lid"], "left").select("key", "lid", F.coalesce("component", "lid").alias("g")))
    per = known.groupBy("key", "g").agg(F.count("*").alias("n"), F.min("lid").alias("lead"))
    total = per.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", -F.col("g"), "lead")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    mains = materialize(total.select("key", (-F.col("top.col2")).alias("main"), F.col("top.lead").alias("lead"), ((F.col("all") - F.col("top.n")) * F.col("all")).alias("many")))
    return known, mains


def leads(known: DataFrame, mains: DataFrame) -> DataFrame:
    """Pairs (a, b): of each key and group but the key's largest, the smallest line with the smallest of the largest."""
    open_ = skew_join(known, mains, ["key"]).filter("g <> main").groupBy("key", "g", "lead").agg(F.min("lid").alias("lid"))
    return open_.select(F.least("lid", "lead").alias("a"), F.greatest("lid", "lead").alias("b")).distinct()


def apart(known: DataFrame, mains: DataFrame) -> DataFrame:
    """All pairs (a, b) of lines that share a key and are in different groups. One of each pair is outside the key's largest
    group, so only those lines are joined with all of the key's."""
    all_ = skew_join(known, mains.select("key", "main"), ["key"])
    few = all_.filter("g <> main").select(F.col("key").alias("k"), F.col("lid").alias("l"), F.col("g").alias("lg"))
    met = all_.join(few, (F.col("key") == F.col("k")) & (F.col("g") != F.col("lg")) & ((F.col("g") == F.col("main")) | (F.col("lid") < F.col("l"))))
    return met.select(F.least("lid", "l").alias("a"), F.greatest("lid", "l").alias("b")).distinct()


def linked_lines(lines: DataFrame, docs: DataFrame, changed: int, similarity: float, rounds: int = 4) -> DataFrame:
    """(node, component) of lines that are linked, directly or by others.

    Each line is first verified against the smallest line of each key, which joins most families at some comparisons a
    line. While far more pairs than lines are left in different groups, each key's groups are compared by one line
    each, `rounds` times at most. Then the pairs still in different groups are compared, all of them, so no link is lost.
    """
    met = materialize(crowded(lines, choices_of(changed)))
    texts = materialize(texts_of(met, lines, docs))
    first = materialize(met.filter("lid <> head").select(F.col("head").alias("a"), F.col("lid").alias("b")).distinct())
    edges = materialize(verified(first, texts, similarity))
    lone, groups = met.count(), connected_components(edges, "a", "b")
    scratch = [met, texts, first, edges]
    for at in range(rounds + 1):
        known, mains = grouped(met, groups)
        many = mains.agg(F.sum("many")).first()[0] or 0
        if not many:
            discard(known, mains)
            break
        last = at == rounds or many <= 4 * lone
        asked = apart(known, mains) if last else leads(known, mains)
        found = materialize(verified(asked.join(first, ["a", "b"], "left_anti"), texts, similarity))
        discard(known, mains)
        none = found.isEmpty()
        if not none:
            edges = materialize(edges.unionByName(found))
            scratch.append(edges)
            groups = connected_components(edges, "a", "b")
        discard(found)
        if last:
            break
    discard(*scratch)
    return groups


def dedup_lines(docs: DataFrame, min_chars: int = 20, changed: int = 2, similarity: float = 0.8) -> DataFrame:
    """docs with text less every line that an earlier one stands for, and n_lines_removed.

    docs: doc_id, text and any more columns. Lines are cut at line feeds. Two lines are linked if their normalised forms
    are equal, or their SimHashes agree in all but `changed` of the four blocks and their edit similarity is `similarity`
    or more, in letters; of each connected group the occurrence first in (doc_id, scan order, line) stays, null doc_ids first. Lines
    of fewer than min_chars normalised characters always stay. Every document stays, if with empty text; null text stays
    null; an empty table gives no rows. Equal lines are grouped by partial sums and found again by a join whose hot keys
    AQE can split, so a line may stand in any share of the documents.
    """
    marked = with_row_id(packed(docs, ["doc_id", "text"]))
    rows = materialize(line_rows(marked, min_chars))
    lines = materialize(distinct_lines(rows))
    groups = linked_lines(lines, marked, changed, similarity)
    linked = materialize(lines.join(groups.withColumnRenamed("node", "lid"), "lid").select("h1", "h2", "component", F.struct("doc_id", ROW, "ln").alias("first")))
    heads = linked.groupBy("component").agg(F.min("first").alias("first"))
    fuzzy = skew_join(linked.drop("first"), heads, ["component"]).select("h1", "h2", "first")
    exact = lines.filter("many > 1").join(linked.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", F.struct("doc_id", ROW, "ln").alias("first"))
    keep = materialize(exact.unionByName(fuzzy).select("h1", "h2", F.col(f"first.{ROW}").alias("keep_row"), F.col("first.ln").alias("keep_ln")))
    dropped = skew_join(rows.select("h1", "h2", ROW, "ln"), keep.hint("shuffle_hash"), ["h1", "h2"]).filter((F.col(ROW) != F.col("keep_row")) | (F.col("ln") != F.col("keep_ln")))
    cut = materialize(dropped.groupBy(ROW).agg(F.collect_set("ln").alias("_cut")))
    discard(rows, lines, linked, keep)
    found = marked.join(cut.hint("shuffle_hash"), ROW, "left").withColumn("_lines", F.explode(F.array(F.when(F.col("_cut").isNotNull(), F.split("text", "\n")))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cut"))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n"))
    return unpacked(found, docs.columns, {"n_lines_removed": F.coalesce(F.size("_cut"), F.lit(0))}, {"text": text})
