"""Line dedup as an exact set-similarity join, in DataFrame functions only.

A line's set is its distinct words, lower-cased. A line goes if an earlier one (by document id, then line) has a Jaccard
similarity of at least ``percent``; lines are judged on the input, so a line that itself goes still removes later ones.
Lines without a word stay.

Method (exact set-similarity join): tokens of a set are ordered by rarity. Two sets can only be similar enough if they share a token within their
first ``n - ceil(t n) + 1`` ones (prefix filter), if their sizes differ little enough (length filter), if what follows
the shared token is long enough (positional filter), and if the parities of their hashed tokens differ in no more bits
than the sets may differ in tokens. What passes is held against finer parities, and then verified on all words. Equal sets are one set throughout,
so a line that fills a third of a corpus is one row.

Rarity is the binary logarithm of the count of a token's hash class, over all lines, and then the token's hash: a total
order, as the prefix filter needs, that fits in a table of fixed size.

Odd cases: a null text counts as empty and stays null; a null id counts as larger than all others; rows that share id
and text are one document, of which each row keeps the lines that stay; rows that share an id only are documents of their
own, in the order of a hash of the text; other columns are kept as they are; ``n_lines`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import kept, remove_folder, written

CLASSES = 1 << 16
MARKS = 1 << 20
#: Sizes from here on are not told apart before verification.
MOST = (1 << 16) - 1
#: Sets of more tokens have 128 parities instead of 64.
LONG = 64
#: So many of the earliest sets of a token are tried before the others.
HEADS = 64
ADDED = ["n_lines", "n_removed"]
NO_DOC = (1 << 63) - 1
#: What tells documents apart, and the place of a line; never null.
OWN = ["doc_id", "digest"]
PLACE = [*OWN, "line_no"]


def words(line: Column) -> Column:
    """64-bit hashes of the distinct words of a line in which blanks are the only white space."""
    each = F.array_remove(F.split(F.lower(line), " "), "")  # one plain character: split without a pattern
    return F.array_distinct(F.transform(each, lambda w: F.xxhash64(w)))


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def own_key(id_col: str, text_col: str) -> list[Column]:
    """doc_id (nulls last) and digest of a row."""
    doc = F.col(id_col).cast("long")
    return [F.coalesce(doc, F.lit(NO_DOC)).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string"), doc.isNull()).alias("digest")]


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, line_no (from 0), words (hashes): the lines that have a word."""
    text = F.col(text_col).cast("string")
    for space in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    lines = docs.select(*own_key(id_col, text_col), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(has_word(F.col("line"))).select(*PLACE, words(F.col("line")).alias("words"))


def rarities(lines: DataFrame) -> bytearray:
    """For each hash class of tokens four times the binary logarithm of its count: CLASSES numbers, whatever the corpus."""
    token = F.col("word").bitwiseAND(F.lit(CLASSES - 1)).cast("int")
    counts = lines.select(F.explode("words").alias("word")).select(token.alias("class")).groupBy("class").count()
    table = bytearray([1]) * CLASSES
    for row in counts.collect():
        table[row["class"]] = min(127, 1 + int(4 * math.log2(row["count"])))
    return table


def parity(tokens: str, part: int, span: Column) -> Column:
    """64 of ``span`` bits, from 64 * ``part`` on: whether an odd number of the tokens hash there."""
    place = lambda t: F.pmod(F.shiftright(t, 8), span).cast("int") - 64 * part
    bit = lambda t: F.when(place(t).between(0, 63), F.call_function("shiftleft", F.lit(1).cast("long"), place(t))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))


def odd_bits(tokens: str, marked: bool = False) -> Column:
    """64 bits: whether an odd number of the tokens (or of those whose bit 26 is set) have that number in bits 20 to 25."""
    one = lambda t: F.shiftright(t, 26).bitwiseAND(F.lit(1).cast("long")) if marked else F.lit(1).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", one(t), F.shiftright(t, 20).bitwiseAND(F.lit(63)).cast("int"))))


def coded(lines: DataFrame, table: bytearray, percent: int) -> DataFrame:
    """doc_id, digest, line_no and for each set: key, n, odd and more (parities), prefix (hashes of its rarest tokens, in order)."""
    low = F.lit((1 << 48) - 1)
    classes = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # becomes a constant before it runs

    def order(h: Column) -> Column:
        rarity = F.coalesce(F.get(classes, h.bitwiseAND(F.lit(CLASSES - 1)).cast("int")), F.lit(0))  # never null, so that sorting works on plain longs
        return F.shiftleft(rarity.cast("long"), 48).bitwiseOR(h.bitwiseAND(low))

    n = F.size("tokens")
    need = F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("int")
    with_tokens = lines.withColumn("tokens", F.sort_array(F.transform("words", order)))
    return with_tokens.select(
        *PLACE, F.xxhash64("tokens").alias("key"), n.alias("n"), odd_bits("tokens").alias("odd"),
        F.when(n > LONG, odd_bits("tokens", marked=True)).otherwise(F.lit(0).cast("long")).alias("more"),
        F.transform(F.slice("tokens", F.lit(1), n - need + 1), lambda t: F.hash(t)).alias("prefix"),
    )


def distinct_sets(sets: DataFrame) -> tuple[DataFrame, str]:
    """One row for each set, with its first line; ``id`` grows with that line's place. In a folder, the second result:
    two scans of files are known to be the same, so an exchange of them can serve twice."""
    one = sets.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("first"), *[F.any_value(c).alias(c) for c in ("n", "odd", "more", "prefix")])
    ordered = one.select("first.*", "n", "odd", "more", "prefix").orderBy(*PLACE)
    return written(ordered.withColumn("id", F.monotonically_increasing_id()), "sets")


def token_rows(one: DataFrame, percent: int, settled: DataFrame | None = None) -> DataFrame:
    """token, token_n_at, own, odd, more: a row for each prefix token, dealt by the token. ``own`` is twice the id, and one
    more if the set is ``settled`` (``b``). Sets too short to be similar to another one have none: n of n + 1 words is their best.

    Four numbers a row are moved; what windows need besides comes after that, as they would have it moved as well.
    """
    own = F.col("id") * 2
    if settled is not None:
        one = one.join(settled.select(F.col("b").alias("id"), F.lit(1).alias("settled")), "id", "left")
        own = own + F.coalesce("settled", F.lit(0))
    rows = one.where(F.col("n") * (100 - percent) >= percent).select(own.alias("own"), "odd", "more", "n", F.posexplode("prefix").alias("at", "token"))
    short = lambda c: F.least(F.col(c), F.lit(MOST)).cast("long")
    packed = F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(F.shiftleft(short("n"), 16)).bitwiseOR(short("at"))
    by_token = rows.select(packed.alias("token_n_at"), "own", "odd", "more").repartition(token(F.col("token_n_at")))
    return by_token.withColumn("token", token(F.col("token_n_at")))


def token(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def fits(x: str, y: str, percent: int) -> Column:
    """Whether two prefix rows with one token leave room for sets that are similar enough; long sizes are not told apart."""
    t = percent / 100
    part = lambda c, bits: F.shiftright(F.col(c), bits).bitwiseAND(F.lit(MOST)).cast("int")
    nx, ny, ax, ay = part(f"{x}.token_n_at", 16), part(f"{y}.token_n_at", 16), part(f"{x}.token_n_at", 0), part(f"{y}.token_n_at", 0)
    need = F.ceil((nx + ny) * (t / (1 + t)) - 1e-9)
    odd, more = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("odd", "more"))
    # two long sets have 128 bits: those of the marked tokens, and of the others
    apart = F.when(F.least(nx, ny) > LONG, F.bit_count(more) + F.bit_count(odd.bitwiseXOR(more))).otherwise(F.bit_count(odd))
    room = (
        (F.least(nx, ny) >= F.greatest(nx, ny) * t - 1e-9)
        & (F.least(nx - ax, ny - ay) >= need - F.least(ax, ay))
        & (apart <= nx + ny - 2 * need)
    )
    return room | (F.greatest(nx, ny) == MOST)


def id_of(own: str) -> Column:
    return F.shiftright(own, 1)


def candidates(earlier: DataFrame, later: DataFrame, percent: int) -> DataFrame:
    """``a, b``: ids of an earlier and a later set that may be similar enough; once for each token they share."""
    x, y = earlier.alias("x"), later.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.own") < F.col("y.own")) & fits("x", "y", percent)
    return x.join(y.hint("merge"), same).select(id_of("x.own").alias("a"), id_of("y.own").alias("b"))


def leading(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b`` as in ``candidates``, with the earliest set of each token only: one row at most for each prefix token."""
    own = F.struct("own", "token_n_at", "odd", "more")
    first = F.first(own).over(Window.partitionBy("token").orderBy("own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = rows.select(first.alias("x"), own.alias("y"))  # a running first: nothing of a token is held but that row
    return met.where((F.col("x.own") < F.col("y.own")) & fits("x", "y", percent)).select(id_of("x.own").alias("a"), id_of("y.own").alias("b"))


def placed(rows: DataFrame) -> DataFrame:
    """``place`` (from 1): the how manieth of its token's sets each row is of."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy("own")))


def open_pairs(rows: DataFrame, percent: int, after: bool) -> DataFrame:
    """``a, b`` of the open sets with the HEADS earliest sets of each token, or with the ones ``after`` these.

    Both sides come out of one exchange: what makes them differ is asked by place, behind the windows.
    """
    at = placed(rows)
    least = HEADS if after else 0
    earlier = at.where(F.col("place") > HEADS if after else F.col("place") <= HEADS)
    later = at.where((F.col("place") > least + 1) & (F.col("own").bitwiseAND(F.lit(1)) == 0))
    return candidates(earlier, later, percent).distinct()


def mark(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(MARKS)).cast("int")


def meeting(rows: DataFrame, keys: list[Column], marks: DataFrame, how: str) -> DataFrame:
    """The rows whose keys have a ``mark`` (or none): a filter by at most MARKS broadcast numbers; a join stays to be done."""
    return rows.join(F.broadcast(marks.distinct()), mark(*keys) == F.col("mark"), how)


def sets_of(lines: DataFrame, one: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, words`` of the sets in the pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = kept(one.select("id", *PLACE).join(ids, "id", "left_semi"))
    place = [F.col(c) for c in PLACE]
    likely = meeting(lines, place, wanted.select(mark(*place).alias("mark")), "left_semi")
    return likely.join(wanted, PLACE).dropDuplicates(["id"]).select("id", "words")


def verified(lines: DataFrame, one: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``b`` of the pairs that are similar enough on all their words, compared by 64-bit hashes.

    Words only travel for pairs whose 256 parities differ in no more places than the sets may differ in words.
    """
    sketches = kept(sets_of(lines, one, pairs).select("id", F.size("words").alias("n"), *[parity("words", k, F.lit(256)).alias(f"odd{k}") for k in range(4)]))
    near = pairs
    for side in ("a", "b"):
        near = near.join(sketches.select(F.col("id").alias(side), F.struct("n", *[f"odd{k}" for k in range(4)]).alias(f"s{side}")), side)
    apart = sum((F.bit_count(F.col(f"sa.odd{k}").bitwiseXOR(F.col(f"sb.odd{k}"))) for k in range(4)), F.lit(0))
    total = F.col("sa.n") + F.col("sb.n")
    # at least so many common words are needed, so at most the rest may differ
    near = kept(near.where(apart <= total - 2 * F.ceil(total * percent / F.lit(100.0 + percent) - 1e-9)).select("a", "b"))
    found = sets_of(lines, one, near)
    met = near.join(found.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(found.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return met.where(100 * common >= percent * (F.size("wa") + F.size("wb") - common)).select("b").distinct()


def repeated_sets(lines: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """``b``: ids of the sets for which a similar one came earlier.

    Each set is first held against the earliest sets that have its tokens, and of these against the earliest that fits:
    this settles nearly all sets of a large group of copies with one row for each token and one pair, however large the
    group. Sets that it leaves open are held against the HEADS earliest sets of each token, and those that are open then
    against all later ones.
    """
    met = leading(token_rows(one, percent), percent).groupBy("b").agg(F.min("a").alias("a"))
    found = kept(verified(lines, one, kept(met.select("a", "b")), percent))
    for after in (False, True):
        pairs = kept(open_pairs(token_rows(one, percent, settled=found), percent, after))
        found = kept(found.union(verified(lines, one, pairs, percent)))
    return found


def kept_lines(one: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, digest, ``bits``: for each document a map from line_no / 32 to the bits of its lines that stay."""
    first = one.select("id", *PLACE).join(repeated.withColumnRenamed("b", "id"), "id", "left_anti")
    word, bit = F.floor(F.col("line_no") / 32).cast("int"), F.pmod("line_no", F.lit(32))
    bits = first.select(*OWN, word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    return bits.groupBy(*OWN, "word").agg(F.bit_or("bit").alias("bits")).groupBy(*OWN).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def changed_documents(lines: DataFrame, stays: DataFrame) -> DataFrame:
    """``mark``, a hash of id and digest, of the documents that lose a line: at most MARKS numbers."""
    had = lines.groupBy(*OWN).agg(F.count("line_no").alias("n"))
    has = stays.select(*OWN, F.aggregate(F.map_values("bits"), F.lit(0), lambda a, b: a + F.bit_count(b)).alias("m"))
    return kept(had.join(has, OWN, "left").where("m is null or m < n").select(mark(*[F.col(c) for c in OWN]).alias("mark")).distinct())


def deduplicate(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as text, and n_lines (with a word) and n_removed of each document.

    Only documents that may lose a line meet their lines in a shuffle; the others pass as they are.
    """
    lines, folder = written(split_lines(docs, id_col, text_col), "lines")  # texts are taken apart once
    one, sets_folder = distinct_sets(coded(lines, rarities(lines), percent))
    stays = kept(kept_lines(one, repeated_sets(lines, one, percent)))
    # the row stays apart, so that its columns may have any name
    rows = docs.select(*own_key(id_col, text_col), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c not in ADDED]).alias("row"))
    changed = changed_documents(lines, stays)
    for done in (folder, sets_folder):
        remove_folder(docs.sparkSession, done)
    own = [c for c in docs.columns if c not in ADDED]
    count = lambda c: F.greatest(F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), has_word)), F.lit(0)).cast("long")
    parts = F.split("text", "\n")
    key = [F.col(c) for c in OWN]
    as_is = meeting(rows, key, changed, "left_anti").select("row.*", count(parts).alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    whole = meeting(rows, key, changed, "left_semi").select(*OWN, parts.alias("parts"), "row")
    joined = whole.join(stays, OWN, "left")
    last = F.floor((F.size("parts") - 1) / 32).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.element_at("bits", w), F.lit(0).cast("long")))
    joined = joined.select("row", "parts", dense.alias("dense"))
    bit = lambda i: F.call_function("shiftright", F.get("dense", F.floor(i / 32).cast("int")), F.pmod(i, F.lit(32)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    joined = joined.withColumn("left", F.filter("parts", lambda line, i: ~has_word(line) | (bit(i) == 1)))
    new = [F.array_join("left", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own]
    n_lines = count(F.col("parts"))
    return as_is.unionByName(joined.select(*new, n_lines.alias("n_lines"), (n_lines - count(F.col("left"))).alias("n_removed")))
