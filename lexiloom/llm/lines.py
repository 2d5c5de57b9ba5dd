"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line is equal, or, for longer lines, if an earlier line differs by one word
replaced, inserted or deleted. Two lines within that bound become equal when each loses at most one
word. So lines emit a key for every word left out, and lines that share a key meet the earliest one
there, which a grouped minimum finds without pairing the others. Only lines that share half their words
with another line can be within the bound, which keeps the neighbourhoods of most lines unbuilt.

Where both lines lose a word at one place, the key is the sum of all words by their places without the
one left out. Where one line is longer, places shift: lines are first held against each other by sums
without places, and only those that meet so get keys by the order of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import plain_spaces
from ..storage import drop_table, write_table
from .words import UNSPACED, fresh

#: Lines with fewer words repeat by chance and stay.
LEAST_WORDS = 5
#: Lines from this many words on also go for an earlier line one word away.
NEAR_WORDS = 10
#: Tables of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 200_000
_UNSPACED_LETTER = rf"[{UNSPACED}]\p{{M}}*"
#: Only lines with one of these can hold white space other than a space, or letters of scripts without
#: spaces. One range is looked through several times faster than all of theirs.
_RARE = f"[^ -{chr(ord(UNSPACED[0]) - 1)}]"
#: Two primes under 2^31 with bases: word sequences are polynomials modulo each. Fixed values.
_FIELDS = ((2147483629, 1000003), (2147483587, 998244))
_POWER_BITS = 24
#: Sums of word hashes are kept modulo 2^62, so that two of them never leave a bigint.
_SUM_BITS = 62
#: What a key stands for, as bits: a word left out, a whole line, a word left out at a known place.
_CUT, _WHOLE, _GAP = 1, 2, 4


def _power(base: int, exponent: Column, prime: int) -> Column:
    """``base ** exponent % prime`` by the bits of the exponent."""
    out, step = F.lit(1).cast("bigint"), base
    for bit in range(_POWER_BITS):
        out = (out * F.when(F.shiftright(exponent, bit).bitwiseAND(1) == 1, step).otherwise(1)) % prime
        step = step * step % prime
    return out


def _plain_spaced(line: Column) -> Column:
    """A line in lower case with spaces as its only white space.

    Every letter of a script without spaces is a word of its own.
    """
    apart = plain_spaces(F.lower(F.regexp_replace(line, _UNSPACED_LETTER, " $0 ")))
    return F.when(F.rlike(line, F.lit(_RARE)), apart).otherwise(F.lower(line))


def plain_words(line: Column) -> Column:
    """Words of a line; case and white space do not count. Plain characters need no regex engine."""
    return F.array_remove(F.split(_plain_spaced(line), " "), "")


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.xxhash64(text).alias("doc"), F.split(text, "\n").alias("lines"))


def _place() -> Column:
    """Documents by id, null last, then by their texts; lines by position."""
    return F.struct(F.col("id").isNull().alias("last"), "id", "doc", "pos")


def _halves(plain: Column, n: Column) -> Column:
    """Hashes of the leading and the trailing half of the words of a line with single spaces.

    Of two lines one word apart, one half is free of the edit. Its length is that of the shorter line's
    half, so lines with an odd number of words give both roundings.
    """
    down, up = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")

    def part(count: Column) -> Column:
        return F.call_function("substring_index", plain, F.lit(" "), count)

    def both(size: Column) -> list[Column]:
        return [F.xxhash64(F.lit("head"), part(size)), F.xxhash64(F.lit("tail"), part(-size))]

    return F.when(n < NEAR_WORDS, F.array().cast("array<bigint>")).when(
        down == up, F.array(*both(down))).otherwise(F.array(*both(down), *both(up)))


def _hashed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, doc, pos, n, h, halves`` of every line.

    Words are counted and hashed inside the line, with single spaces between them; no word becomes a value
    of its own. Short lines are left out by whoever reads the table: a filter here would split every line twice.
    """
    place = ["id", "doc", "pos"]
    # No text is without lines. The plain explode would split each once more to see that.
    lines = _documents(docs, key, text).select("id", "doc", F.posexplode_outer("lines").alias("pos", "line"))
    flat = lines.select(*place, _plain_spaced(F.col("line")).alias("flat"))
    single = F.when(F.contains("flat", F.lit("  ")), F.regexp_replace("flat", " +", " ")).otherwise(F.col("flat"))
    plain = flat.select(*place, F.trim(single).alias("plain"))
    spaces = F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit("")))
    sized = plain.select(*place, F.when(F.col("plain") == "", 0).otherwise(spaces + 1).alias("n"), "plain")
    return sized.select(*place, "n", F.xxhash64("plain").alias("h"),
                        _halves(F.col("plain"), F.col("n")).alias("halves"))


def _checked(table: DataFrame) -> DataFrame:
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if small else table


def _by_document(docs: DataFrame, table: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """Join what is known of a document, found by its id and text, to it."""
    known = _checked(table.withColumnRenamed("id", "_kid").withColumnRenamed("doc", "_kdoc"))
    return docs.join(known, (F.xxhash64(docs[text]) == known["_kdoc"]) & docs[key].eqNullSafe(known["_kid"]),
                     how)


def _read_words(chosen: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add the words of the chosen distinct lines, from the documents they come first in."""
    rows = chosen.select("place.id", "place.doc", F.struct("h", "n", "place").alias("line"))
    per_doc = rows.groupBy("id", "doc").agg(F.collect_list("line").alias("_wanted"))
    found = _by_document(docs.select(key, text), per_doc, key, text, "inner").select(
        "_wanted", F.split(text, "\n").alias("lines"))
    # Explode after the lines are taken: else a text is split for each of them.
    read = F.transform("_wanted", lambda w: F.struct(
        w["h"].alias("h"), w["n"].alias("n"), w["place"].alias("place"),
        F.get("lines", w["place"]["pos"]).alias("line")))
    return found.select(F.inline(read)).select(
        "h", "n", "place", plain_words(F.col("line")).alias("words")).dropDuplicates(["h", "n"])


def _sum_term(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - _SUM_BITS)


def _modulo(total: Column) -> Column:
    return total.bitwiseAND(F.lit((1 << _SUM_BITS) - 1))


def _keys(chosen: DataFrame) -> DataFrame:
    """``h, n, place, key, kind``: a key per word left out and its place (``_GAP``), and keys without
    places per word left out (``_CUT``) and per whole line (``_WHOLE``)."""
    def total(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: _modulo(a + x))

    summed = chosen.select("h", "n", "place", "words",
                           total(F.transform("words", lambda w, i: _sum_term(i, w))).alias("placed"),
                           total(F.transform("words", lambda w: _sum_term(w))).alias("loose"))
    words = summed.select("h", "n", "place", "placed", "loose", F.posexplode("words").alias("at", "word"))
    gap = F.xxhash64("n", "at", _modulo(F.col("placed") - _sum_term(F.col("at"), F.col("word"))))
    cut = F.xxhash64(F.col("n") - 1, _modulo(F.col("loose") - _sum_term(F.col("word"))))

    def keyed(rows: DataFrame, *keys: tuple[Column, int]) -> DataFrame:
        pairs = F.array(*[F.struct(key.alias("key"), F.lit(kind).alias("kind")) for key, kind in keys])
        return rows.select("h", "n", "place", F.inline(pairs))

    return keyed(words, (gap, _GAP), (cut, _CUT)).unionByName(
        keyed(summed, (F.xxhash64("n", "loose"), _WHOLE)))


def _variants(chosen: DataFrame) -> DataFrame:
    """A row per line and word left out (``at``), and one per whole line (``at`` -1).

    ``key`` and ``size`` stand for the words that are left, wherever the missing one was.
    """
    words = chosen.select("h", "place", "n", F.posexplode("words").alias("at", "word"))
    line = Window.partitionBy("h", "n")
    before = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    terms, keys, wholes = {}, [], []
    for i, (prime, base) in enumerate(_FIELDS):
        code = F.pmod(F.xxhash64(F.lit(i), "word"), F.lit(prime - 1)) + 1
        terms[f"t{i}"] = (code * _power(base, F.col("at"), prime)) % prime
    rows = words.select("h", "place", "n", "at", *[t.alias(k) for k, t in terms.items()])
    for i in range(len(_FIELDS)):
        rows = rows.withColumn(f"p{i}", F.sum(f"t{i}").over(before)).withColumn(f"s{i}", F.sum(f"t{i}").over(line))
    for i, (prime, base) in enumerate(_FIELDS):
        head = F.col(f"p{i}") - F.col(f"t{i}")
        tail = ((F.col(f"s{i}") - F.col(f"p{i}")) % prime * pow(base, -1, prime)) % prime
        keys.append((head + tail) % prime)
        wholes.append(F.col(f"s{i}") % prime)

    def joined(parts: list[Column]) -> Column:
        return F.shiftleft(parts[0], 31) + parts[1]

    kinds = F.when(F.col("at") == 0, F.array(
        F.struct(joined(keys).alias("key"), (F.col("n") - 1).alias("size"), F.col("at").alias("at")),
        F.struct(joined(wholes).alias("key"), F.col("n").alias("size"), F.lit(-1).alias("at")),
    )).otherwise(F.array(
        F.struct(joined(keys).alias("key"), (F.col("n") - 1).alias("size"), F.col("at").alias("at"))))
    return rows.select("h", "place", "n", F.explode(kinds).alias("v")).select("h", "place", "n", "v.*")


def _one_word_apart(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one word replaced, inserted or deleted.

    What they share at the front and at the back leaves out at most one word of the longer one.
    """
    longer = F.greatest(F.size(a), F.size(b))

    def shared(x: Column, y: Column) -> Column:
        equal = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
        first = F.array_position(equal, False)
        return F.when(first == 0, F.size(equal)).otherwise(first - 1)

    return shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= longer - 1


def _witnesses(chosen: DataFrame) -> tuple[DataFrame, str]:
    """``h, n, near``: the earliest line one word away from a line, where that is earlier. A written table.

    Few keys are shared, so what is known of these mostly goes to the variants, not the other way round.
    """
    spark = chosen.sparkSession
    rows = _keys(chosen)
    shared = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bit_or("kind").alias("kinds"))
    both = F.col("kinds").bitwiseAND(_CUT | _WHOLE) == _CUT | _WHOLE
    shared, shared_path = write_table(
        shared.where((F.col("lo") != F.col("hi")) & (both | (F.col("kinds").bitwiseAND(_GAP) != 0))).select("key"),
        "lines-shared")
    meet, meet_path = write_table(rows.join(_checked(shared), "key"), "lines-meet")
    # Replaced: the same word is left out of both. Inserted or deleted: one of the two is whole.
    gap = F.col("kind") == _GAP
    gaps = meet.where(gap).groupBy("key").agg(
        F.min("place").alias("near"), F.max("place").alias("last")).where("near != last").drop("last")
    gaps, gaps_path = write_table(gaps, "lines-gaps")
    replaced = meet.where(gap).join(_checked(gaps), "key")
    shifted = chosen.join(_checked(meet.where(~gap).select("h", "n").distinct()), ["h", "n"], "left_semi")
    variants = _variants(shifted)
    cut, whole = F.col("at") >= 0, F.col("at") < 0
    sides = variants.groupBy("key", "size").agg(
        F.min(F.when(whole, F.col("place"))).alias("whole"),
        F.min(F.when(cut, F.col("place"))).alias("cut")).where("whole is not null and cut is not null")
    sides, sides_path = write_table(sides, "lines-sides")
    changed = variants.join(_checked(sides), ["key", "size"]).withColumn(
        "near", F.when(whole, F.col("cut")).otherwise(F.col("whole")))
    columns = ["h", "n", "place", "near"]
    met = replaced.select(columns).unionByName(changed.select(columns)).where(F.col("near") < F.col("place"))
    least = met.groupBy("h", "n").agg(F.min("near").alias("near"))
    mine = least.join(chosen.select("h", "n", F.col("words").alias("a")), ["h", "n"])
    theirs = chosen.select(F.col("place").alias("near"), F.col("words").alias("b"))
    near = mine.join(theirs, "near").where(_one_word_apart(F.col("a"), F.col("b"))).select("h", "n", "near")
    near, path = write_table(near, "lines-near")
    for old in (shared_path, meet_path, gaps_path, sides_path):
        drop_table(spark, old)
    return near, path


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, doc, pos, edits, keeper``: every line that goes, and the earlier line it goes for.

    ``doc`` is the hash of the whole text, ``pos`` counts lines from 0, ``keeper`` is ``last, id, doc,
    pos`` of the earliest line that is equal or one word away. Earlier is by id (null last), then by
    ``doc``, then by position. Rows equal in id and text share their lines: these do not go for each
    other. Null texts have no lines; lines with few words stay.
    """
    spark = docs.sparkSession
    every, _ = write_table(_hashed_lines(docs, key, text), "lines")
    lines = every.where(F.col("n") >= LEAST_WORDS)
    distinct, first_path = write_table(lines.groupBy("h", "n").agg(
        F.min(_place()).alias("first"), F.max(_place()).alias("last")), "lines-first")
    keyed = lines.select("h", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi")
    some = keyed.join(shared.select("half"), "half", "left_semi").select("h").distinct()
    places, places_path = write_table(
        distinct.where(F.col("n") >= NEAR_WORDS).join(some, "h", "left_semi").select(
            "h", "n", F.col("first").alias("place")), "lines-places")
    chosen, chosen_path = write_table(_read_words(places, docs, key, text), "lines-chosen")
    near, near_path = _witnesses(chosen)
    again = distinct.join(near, ["h", "n"], "left").where("first != last or near is not null").select(
        "h", "n", "first", "near")
    gone = lines.drop("halves").join(again, ["h", "n"]).withColumn("place", _place()).where(
        "near is not null or place != first")
    # An earlier line one word away precedes the first equal one as well.
    edits = F.when(F.col("near").isNotNull() & (F.col("place") == F.col("first")), 1).otherwise(0)
    keeper = F.when(edits == 1, F.col("near")).otherwise(F.col("first"))
    out, _ = write_table(gone.select("id", "doc", "pos", edits.alias("edits"), keeper.alias("keeper")),
                         "lines-removed")
    for path in (first_path, places_path, chosen_path, near_path):
        drop_table(spark, path)
    return out


def drop_duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         removed: str | None = None) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``, other columns as they were.

    ``removed`` names a column to hold the number of lines cut; one of that name is replaced.
    """
    name = fresh(docs, "_gone")
    gone = removed_lines(docs, key, text).groupBy("id", "doc").agg(F.collect_set("pos").alias(name))
    # A column of its own: inside the transform below a text would be split again for every line.
    split = fresh(docs, "_lines")
    joined = _by_document(docs, gone, key, text, "left").withColumn(
        split, F.when(F.col(name).isNotNull(), F.split(docs[text], "\n")))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(name)))
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n")
    values = {c: docs[c] for c in docs.columns}
    values[text] = F.when(F.col(name).isNull(), docs[text]).otherwise(rest)
    if removed:
        values = {c: v for c, v in values.items() if c.lower() != removed.lower()}
        values[removed] = F.coalesce(F.size(name), F.lit(0))
    return joined.select(*[v.alias(c) for c, v in values.items()])


def drop_copied_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``drop_duplicate_lines``, without the documents of which no word is left."""
    cut = fresh(docs, "_cut")
    return drop_duplicate_lines(docs, key, text, cut).where(
        (F.col(cut) == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")).drop(cut)
