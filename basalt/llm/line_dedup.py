"""Fuzzy line deduplication with DataFrame functions only.

1. Lines are normalised (lower case, letters and digits, one blank between words); equal ones form a
   class by a grouped aggregation over two 64-bit hashes, so a line that stands everywhere is one row
   before anything is joined.
2. The fingerprint of a class is a SimHash over all words of its line, in ``BLOCKS`` blocks of ``VOTES``
   bits: the hash of a word says in which block it votes. In a plain SimHash every bit depends on
   every word, so one changed word may flip bits in each block; here a changed word reaches two blocks
   at most, an added or missing word one. By the pigeonhole principle two lines that differ in up to two
   changed words have two blocks of equal words at least, and share one for certain if it has ``LEAST`` words.
3. Classes of lines of ``BLOCKED`` words and more meet on such blocks. The key is a 64-bit hash of the
   block's words, not its few bits, so that the number of chance meetings does not grow with the corpus.
4. Shorter lines have too few words a block. They meet on words of the line itself: a line of up to
   ``SHORT`` words on what is left without one of its words or without both ends, others on runs of a third of
   the line at its start, in its middle and at its end. By the pigeonhole principle, longer lines that differ
   in up to two changed words, or one added or missing, share such a key; short ones, if they differ
   in one word or in both ends.
5. Members of a key are compared with its hub, the class that most others meet; those that stay outside of the component
   that most of the key are in with up to ``PROBES`` more of that one, and all that still are in different components
   with each other, each pair in the first key it shares, if the fingerprints of longer lines differ in at most
   ``hamming`` bits and their lengths do not rule it out.
6. Edit similarity 1 - distance / longer length confirms a pair: over characters, or if one line has more
   than ``LONG`` characters over words (one of ``CODES`` characters stands for each word; lengths in
   characters may then differ by a fifth).
7. One occurrence of each connected group stays: the one of smallest (doc id, line number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._graph import connected_components
from basalt.llm._names import column, free, replaced
from basalt.llm._scratch import Scratch

#: Blocks of a fingerprint, bits of a block, and words from which a line meets others on blocks of LEAST words at least.
BLOCKS = 6
VOTES = 7
BLOCKED = 32
LEAST = 4
#: Words of a line that meets others without any one of them.
SHORT = 8
#: Words of a line up to which it meets others on runs (a few more than BLOCKED), and words of a run.
RUN_LINES = 38
RUNS = (3, 4, 5, 6, 8, 10, 12)
#: Characters beyond which edits are counted in words, and the characters that stand for words (from U+3400 on).
LONG = 1024
CODES = 41_984
#: Keys of a class at most: three runs and SHORT + 2 without some words (or, of longer lines, blocks and three more runs).
KEYS = SHORT + 5
#: Members of a key's main component that the others are compared with before all.
PROBES = 16
#: Bits 0, 8, .. 48 of a word's hash are its votes; counts of up to 127 words fit in the lanes between them.
_LANES = sum(1 << 8 * j for j in range(VOTES))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _at_least(norm: Column, words: int) -> Column:
    """Whether a normalised line has so many words."""
    return (norm != "") & (F.substring_index(norm, " ", words - 1) != norm)


def lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc_id, line_no, norm, words) of the lines of at least ``min_words`` words."""
    # Normalised as a whole: a line feed ends every run of characters that becomes a blank.
    whole = F.regexp_replace(F.lower(column(text_col).cast("string")), r"[^\p{L}\p{N}\n]+", " ")
    cut = docs.select(column(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(whole, "\n")).alias("line_no", "norm")).withColumn("norm", F.trim("norm"))
    # Told by a prefix: a filter on the array of words would be pushed down and cut every line twice.
    return cut.where(_at_least(F.col("norm"), min_words)).withColumn("words", F.split("norm", " "))


def blocks(df: DataFrame, hashes: str) -> DataFrame:
    """``df`` with the blocks of each array of word hashes: block i has the words ``_n{i}``, the hash ``_h{i}``
    of them in order of hash, and the bits ``_f{i}`` (at 0, 8, .. 48) for which more than half of them vote.

    Blocks are ranges of the hash, so they are slices of the sorted hashes between the places of the ranges'
    bounds. Blocks of more than 127 words have no bits.
    """
    whole, bounds = df.columns, [-(1 << 63) + (1 << 64) // BLOCKS * i for i in range(1, BLOCKS)]
    df = df.withColumn("_s", F.sort_array(F.concat(hashes, F.array(*map(F.lit, bounds)))))
    df = df.select(*whole, "_s", F.size("_s").alias("_n"), *(F.array_position("_s", F.lit(b)).cast("int").alias(f"_p{i}") for i, b in enumerate(bounds)))
    lows, highs = [F.lit(0), *(F.col(f"_p{i}") for i in range(BLOCKS - 1))], [*(F.col(f"_p{i}") for i in range(BLOCKS - 1)), F.col("_n") + 1]
    df = df.select(*whole, *(F.slice("_s", lo + 1, hi - lo - 1).alias(f"_b{i}") for i, (lo, hi) in enumerate(zip(lows, highs))))
    zero, every = F.lit(0).cast("long"), range(BLOCKS)
    votes = lambda b: F.when(F.size(b) <= 127, F.aggregate(b, zero, lambda a, h: a + h.bitwiseAND(F.lit(_LANES))))
    df = df.select(*whole, *(F.size(f"_b{i}").alias(f"_n{i}") for i in every), *(F.xxhash64(f"_b{i}").alias(f"_h{i}") for i in every), *(votes(f"_b{i}").alias(f"_v{i}") for i in every))
    # A lane's top bit is set once its count exceeds half.
    top = lambda i: (F.col(f"_v{i}") + (127 - F.shiftright(F.col(f"_n{i}"), 1)) * F.lit(_LANES)).bitwiseAND(F.lit(128 * _LANES))
    bits = (F.coalesce(F.shiftrightunsigned(top(i), 7), zero).alias(f"_f{i}") for i in every)
    return df.select(*whole, *(f"_n{i}" for i in every), *(f"_h{i}" for i in every), *bits)


def fingerprint() -> Column:
    """The bits of all blocks in one number."""
    out = F.col("_f0")
    for i in range(1, BLOCKS):
        out = out.bitwiseOR(F.shiftleft(F.col(f"_f{i}"), i))
    return out


def _codes(hashes: Column) -> Column:
    """A text of one character a word."""
    return F.decode(F.unhex(F.array_join(F.transform(hashes, lambda h: F.hex(F.pmod(h, F.lit(CODES)) + 0x3400)), "")), "UTF-16BE")


def _key(kind: int, value: Column) -> Column:
    """A 64-bit key with its kind in the top bits: words left (2) sort before runs (3) and blocks (0)."""
    return F.shiftrightunsigned(value, 2).bitwiseOR(F.lit(((kind + 2) % 4 - 2) << 62))


def _without(hashes: str) -> Column:
    """The keys of a line of at most SHORT words without any one of them, or without both ends."""
    h, n = F.col(hashes), F.size(hashes)
    # Position SHORT leaves no word out. Without both ends, two words at least must be left.
    less = F.transform(F.sequence(F.lit(0), F.lit(SHORT)), lambda j: F.xxhash64(F.filter(h, lambda _, i: i != j)))
    less = F.when(n >= 4, F.concat(less, F.array(F.xxhash64(F.slice(h, F.lit(2), F.greatest(n - 2, F.lit(1))))))).otherwise(less)
    return F.array_distinct(F.transform(less, lambda k: _key(2, k)))


def _runs(hashes: str, words: str) -> list[Column]:
    """The keys of a line of SHORT to RUN_LINES words: runs of a third of it at its start, middle and end."""
    n = F.col(words)
    fits = lambda most: F.coalesce(*(F.when(most >= r, F.lit(r)) for r in reversed(RUNS)), F.lit(RUNS[0]))
    # The run of a line and of one that is a tenth shorter, so that both have one of equal length.
    one, two = fits(n / 3), fits(n * 0.9 / 3)
    run = lambda r, start, side: _key(3, F.xxhash64(F.lit(side), F.slice(hashes, start, r)))
    thirds = lambda r: (run(r, F.lit(1), 0), run(r, F.floor((n - r) / 2).cast("int") + 1, 1), run(r, n - r + 1, 2))
    fit = n.between(SHORT, RUN_LINES)
    return [*(F.when(fit, k) for k in thirds(one)), *(F.when(fit & (one != two), k) for k in thirds(two))]


def _core(p: Column, q: Column) -> Column:
    """(p, q) without up to 1023 characters of their common start and end, found by halving steps; edit
    distance does not change."""
    pair = lambda x, y: F.struct(x.alias("p"), y.alias("q"))
    tail = lambda x, s: F.substring(x, -s, s)
    after = lambda x, s: F.substring(x, s + 1, F.length(x))
    until = lambda x, s: F.substring(x, F.lit(1), F.length(x) - s)
    steps = F.array(*(F.lit(1 << k) for k in range(9, -1, -1)))
    front = lambda a, s: F.when(F.substring(a["p"], F.lit(1), s) == F.substring(a["q"], F.lit(1), s), pair(after(a["p"], s), after(a["q"], s))).otherwise(a)
    back = lambda a, s: F.when(tail(a["p"], s) == tail(a["q"], s), pair(until(a["p"], s), until(a["q"], s))).otherwise(a)
    return F.aggregate(steps, F.aggregate(steps, pair(p, q), front), back)


def _close(pairs: DataFrame, share: float) -> DataFrame:
    """The (src, dst) of ``pairs`` whose texts p and q are alike.

    The distance table of whole texts costs the product of their lengths, so it comes last: texts pass
    without it whose differing middles are short enough, or whose words differ little one by one.
    """
    most = F.floor(F.greatest(F.length("p"), F.length("q")) * (1 - share) + 1e-9).cast("int")
    cut = pairs.withColumn("most", most).where(F.abs(F.length("p") - F.length("q")) <= F.col("most"))
    # Generated, since a plain column would go into the condition and be computed anew wherever it is named there.
    cut = cut.select("src", "dst", "most", F.inline(F.array(_core(F.col("p"), F.col("q")))))
    p, q = F.col("p"), F.col("q")
    one, two = F.split(p, " "), F.split(q, " ")
    word = lambda x, y: F.when(x == y, F.lit(0)).otherwise(F.levenshtein(x, y))
    aligned = F.aggregate(F.zip_with(one, two, word), F.lit(0), lambda n, x: n + x)
    # Blanks align with blanks, so the sum is the cost of one way to edit p into q.
    by_word = F.when(F.size(one) == F.size(two), aligned <= F.col("most")).otherwise(F.lit(False))
    near = F.when(F.greatest(F.length(p), F.length(q)) <= F.col("most"), F.lit(True)).when(by_word, F.lit(True))
    return cut.where(near.otherwise(F.call_function("levenshtein", p, q, F.col("most")) >= 0)).select("src", "dst")


def prepared(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Each line's place, hashes (k1, k2), lengths, fingerprint, keys (c0, c1, ..) and what edits are counted on."""
    seen = lines(docs, id_col, text_col, min_words).select(
        "doc_id", "line_no", "norm", F.length("norm").alias("n"), F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(7), "norm").alias("k2"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    seen = seen.withColumn("words", F.size("hashes")).select("*", F.when(F.col("n") > 0.8 * LONG, _codes(F.col("hashes"))).alias("codes"), F.when(F.col("words") <= SHORT, _without("hashes")).alias("less"))
    seen = seen.select("*", *(k.alias(f"r{i}") for i, k in enumerate(_runs("hashes", "words"))))
    seen = blocks(seen.withColumn("hashes", F.when(F.col("words") >= BLOCKED, F.col("hashes"))), "hashes")
    block = lambda i: F.when(F.col(f"_n{i}") >= LEAST, _key(0, F.xxhash64(F.lit(i), f"_h{i}")))
    # The places of the keys: runs, then blocks or, in short lines, what is left without a word.
    rest = [block(i) if i < BLOCKS else F.lit(None).cast("long") for i in range(KEYS - 3)]
    short = [F.get("less", F.lit(i)) for i in range(KEYS - 3)]
    keys = [F.col("r0"), F.col("r1"), F.col("r2"), *(F.coalesce(b, s) for b, s in zip(rest, short))]
    keys[3 + BLOCKS : 6 + BLOCKS] = [F.coalesce(k, F.col(f"r{i}")) for i, k in enumerate(keys[3 + BLOCKS : 6 + BLOCKS], 3)]
    return seen.select("doc_id", "line_no", "k1", "k2", "n", "words", F.when(F.col("n") <= LONG, F.col("norm")).alias("norm"), "codes", fingerprint().alias("sim"), *(k.alias(f"c{i}") for i, k in enumerate(keys)))


def _removed(docs: DataFrame, id_col: str, text_col: str, min_words: int, share: float, hamming: int, work: Scratch) -> DataFrame:
    """As ``removed_lines``, with repeated rows for repeated ids; the result reads the table ``occurs`` of ``work``."""
    # ``row`` is fixed once it is written.
    seen = work.table(prepared(docs, id_col, text_col, min_words).withColumn("row", F.monotonically_increasing_id()), "lines")
    facts, keys = ["n", "words", "sim"], [f"c{i}" for i in range(KEYS)]
    classes = seen.groupBy("k1", "k2").agg(F.count("*").alias("times"), *(F.min(c).alias(c) for c in ["row", *facts, *keys]))
    # The number of a class: how frequent it is (a power of four), then its hash; so of members that are met
    # equally often the most frequent is the hub.
    level = F.least(F.floor(F.log2("times") / 2), F.lit(15)).cast("long")
    classes = work.table(classes.withColumn("id", F.shiftleft(level, 59).bitwiseOR(F.shiftrightunsigned("k1", 5))), "classes")
    held = F.array(*keys)

    # (key, id, size) of the keys that more than one class has; dealt by key once, for the count and for the join.
    banded = classes.select("id", F.explode(held).alias("key")).where("key is not null").repartition("key")
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = work.table(banded.join(shared.hint("shuffle_hash"), "key"), "members")

    # One row for each class that shares a key: its facts and keys, what edits are counted on, and how many meet it.
    weights = members.groupBy("id").agg(F.sum("size").alias("weight")).join(classes.select("id", "row", *facts, held.alias("keys")), "id")
    faces = work.table(seen.select("row", "norm", "codes").join(weights.hint("shuffle_hash"), "row").drop("row"), "faces")

    # Lengths that differ by more than the edits allowed can't pass _close.
    differ = lambda c, s: F.abs(F.col(f"{c}1") - F.col(f"{c}2")) <= F.floor(F.greatest(f"{c}1", f"{c}2") * s + 1e-9)
    bits = F.bit_count(F.col("sim1").bitwiseXOR(F.col("sim2")))
    alike = F.when(F.greatest("n1", "n2") <= LONG, differ("n", 1 - share)).otherwise(differ("words", 1 - share) & differ("n", 0.2))
    alike = alike & ((F.least("words1", "words2") < BLOCKED) | (bits <= hamming))
    of = lambda i, *more: [*(F.col(c).alias(f"{c}{i}") for c in facts), *more]
    # The hub of a key is the member that most others meet over all its keys, so the one that most are near to.
    met = work.table(members.join(faces.select("id", "weight", *facts), "id").select("key", "id", "weight", *facts), "met")
    hubs = met.groupBy("key").agg(F.max(F.struct("weight", "id", *facts)).alias("hub")).select("key", F.col("hub.id").alias("dst"), *(F.col(f"hub.{c}").alias(f"{c}2") for c in facts))
    first = met.select("key", *of(1, F.col("id").alias("src"))).join(hubs, "key").where((F.col("src") != F.col("dst")) & alike)
    ordered = lambda x, y: (F.greatest(x, y).alias("src"), F.least(x, y).alias("dst"))
    tried = work.table(first.select(*ordered("src", "dst")).distinct(), "pairs-1")
    work.drop("members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.join(faces.select(F.col("id").alias("src"), F.col("norm").alias("norm1"), F.col("codes").alias("codes1")), "src")
        both = left.join(faces.select(F.col("id").alias("dst"), F.col("norm").alias("norm2"), F.col("codes").alias("codes2")), "dst")
        # The kind of signature is chosen for the pair: words for both lines if either is long.
        chars = F.col("norm1").isNotNull() & F.col("norm2").isNotNull()
        pick = lambda i: F.when(chars, F.col(f"norm{i}")).otherwise(F.col(f"codes{i}"))
        return _close(both.select("src", "dst", pick(1).alias("p"), pick(2).alias("q")), share)

    found = connected_components(work.table(confirmed(tried), "links-1"), work, "cc-1")
    comp = faces.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), F.col("component").isNotNull().alias("linked"))
    comp = work.table(comp, "comp")

    def between(links: DataFrame) -> DataFrame:
        """The (src, dst) of the components that ``links`` join."""
        ends = links.join(comp.select(F.col("id").alias("src"), F.col("comp").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("comp").alias("b")), "dst")
        return ends.select(*ordered("a", "b")).distinct()

    # Members of keys that hold several components, with the component that most of a key's members are in.
    mixed = met.join(comp.drop("linked"), "id")
    held_by = mixed.groupBy("key", "comp").agg(F.count("*").alias("most")).groupBy("key").agg(F.max(F.struct("most", "comp")).alias("top"), F.count("*").alias("comps"))
    mixed = mixed.join(held_by.where("comps > 1").select("key", F.col("top.comp").alias("main"), F.col("top.most").alias("most")), "key")
    mixed = work.table(mixed.join(faces.select("id", "keys"), "id"), "mixed")
    work.drop("met")
    side = lambda df, i, *more: df.select("key", *of(i, *(F.col(c).alias(f"{c}{i}") for c in ("id", *more))))
    rest = mixed.where("comp <> main")

    # Where many are in that component, the others meet PROBES more of its members first: one link spares the pairs with all.
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), F.desc("id")))
    heads = mixed.where((F.col("comp") == F.col("main")) & (F.col("most") > PROBES)).withColumn("rank", rank).where(F.col("rank") <= PROBES)
    probes = side(rest, 1).join(side(heads, 2), "key").where(alike).select(*ordered("id1", "id2")).distinct()
    probes = work.table(probes.join(tried, ["src", "dst"], "left_anti"), "probes")
    joined = work.table(between(confirmed(probes)), "links-2")
    # A component goes by the smallest one it is linked to, so equal labels are one component.
    label = joined.groupBy(F.col("src").alias("comp")).agg(F.min("dst").alias("label"))
    mixed = mixed.join(label, "comp", "left").withColumn("label", F.coalesce("label", "comp"))

    # All other pairs across components; those of the main one are not paired with each other.
    across = side(mixed.where("comp <> main"), 1, "keys", "label").join(side(mixed, 2, "keys", "label", "comp", "main"), "key")
    across = across.where((F.col("label1") != F.col("label2")) & ((F.col("comp2") == F.col("main2")) | (F.col("id1") > F.col("id2"))) & alike & (F.array_min(F.array_intersect("keys1", "keys2")) == F.col("key")))
    across = across.select(*ordered("id1", "id2")).join(tried.union(probes), ["src", "dst"], "left_anti")
    joined = work.table(joined.union(between(confirmed(work.table(across, "pairs-2")))), "links-3")
    for name in ("faces", "mixed", "pairs-1", "probes", "pairs-2", "links-1", "links-2"):
        work.drop(name)
    # Only components are joined further, so the second search is small.
    merged = connected_components(joined, work, "cc-2").select(F.col("id").alias("comp"), "component")
    found = comp.join(merged, "comp", "left").where("linked or component is not null").select("id", F.coalesce("component", "comp").alias("component"))

    # Occurrences of every group of more than one line; all but the first go.
    grouped = classes.select("k1", "k2", "id", "times").join(found, "id", "left").where("times > 1 or component is not null")
    grouped = grouped.select("k1", "k2", F.coalesce("component", "k1").alias("g"), F.when(F.col("component").isNull(), F.col("k2")).alias("g2"))
    occurs = work.table(seen.select("doc_id", "line_no", "k1", "k2").join(grouped, ["k1", "k2"]).select("doc_id", "line_no", "g", "g2"), "occurs")
    for name in ("lines", "classes", "comp", "links-3"):
        work.drop(name)
    stays = occurs.groupBy("g", "g2").agg(F.min(F.struct("doc_id", "line_no")).alias("stay"))
    gone = occurs.join(stays, (occurs.g == stays.g) & occurs.g2.eqNullSafe(stays.g2)).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("stay")))
    return gone.select("doc_id", "line_no").where("doc_id is not null")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 3, share: float = 0.9, hamming: int = 16) -> DataFrame:
    """(doc_id, line_no) of every line of which an equal or similar one stays elsewhere.

    Lines of fewer than ``min_words`` words, blank lines and null or empty texts lose nothing. The
    lines of rows with a null id are compared like others; a null id sorts first, so its lines stay.
    Of rows that repeat an id, the lines of equal number are told apart by nothing: the first stays
    and is not listed. Of equal and similar lines, the one of smallest (doc id, line number) stays,
    so there are no ties. An empty table gives no rows.
    """
    return _removed(docs, id_col, text_col, min_words, share, hamming, Scratch(docs.sparkSession, "line-dedup")).distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 3, share: float = 0.9, hamming: int = 16, removed: str = "removed", emptied: str = "emptied") -> DataFrame:
    """``docs``, all columns and rows, with the repeated lines taken out of the text, and two new last
    columns: ``removed`` (array of line numbers, null if none) and ``emptied`` (lines were taken out
    and none of ``min_words`` words is left). A column of ``docs`` that has such a name gives way to
    the new one; the parameters choose other names."""
    work = Scratch(docs.sparkSession, "line-dedup-out")
    gone = _removed(docs, id_col, text_col, min_words, share, hamming, work)
    key, out_lines, out_empty = free(docs, "_gone_id", "_removed", "_emptied")
    gone = work.table(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias(out_lines)), "removed").withColumnRenamed("doc_id", key)
    work.drop("occurs")
    # Hashed on the side of the removed lines, at every size: no text is sorted, none broadcast.
    out = docs.join(gone.hint("shuffle_hash"), column(id_col) == F.col(key), "left").drop(key)
    text, went = column(text_col), F.col(out_lines)
    cut = F.split(text, "\n")
    kept = F.array_join(F.filter(cut, lambda x, i: ~F.array_contains(went, i)), "\n")
    long_ = F.exists(F.split(text, "\n"), lambda x: _at_least(normalised(x), min_words))
    new = out.select(*(F.when(went.isNull(), text).otherwise(kept).alias(text_col) if c == text_col else column(c) for c in out.columns))
    new = new.withColumn(out_empty, F.when(went.isNull(), F.lit(False)).otherwise(~long_))
    return replaced(new, **{removed: out_lines, emptied: out_empty})
