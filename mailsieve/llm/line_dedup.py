"""Operator 2, line dedup: by content-defined chunks, and the runs of lines beside them.

``run_dedup``, the query's and the pipeline's way, cuts by the chunks described below.
A chunk that stands earlier too is an anchor: a run that ends or begins somewhere in
its neighbours, or that holds no whole chunk, is found by every two lines that follow
each other; those inside an anchor need no look. Blank lines between two lines belong
to them. A run with ``MIN_LINES`` or more lines that aren't blank, which stands at an
earlier place too, by smallest id and then position, is made of just such pairs, in
anchors or beside them, so their lines are all lines of all shared runs, from the first
line of a run that isn't blank to its last, wherever it begins or ends. A line's first
place of all always stays, and so does a shared line whose neighbours differ, also
between blank lines. A pair that overlaps its own first place (three like lines) isn't
a copy of it; of a text that is left with blank lines only nothing stays. Chunks and
pairs are compared by 128-bit hash without their text; the bytes of all that repeat are
compared thereafter, and if a hash belongs to two texts, pairs are grouped by text.

``line_dedup`` cuts by content-defined chunks. Each line is hashed, a rolling hash runs
over the hashes of the last ``WINDOW`` lines, and a chunk ends where that hash falls on
one of ``SPREAD`` values. Boundaries thus depend on nearby lines only: lines put
in or taken out elsewhere don't shift them. A chunk of more than one line that
stands somewhere else too is removed everywhere but at its first place. Runs that
hold no two chunk ends stay, which are most of the short ones.

There, parts are grouped by 128-bit hash *and* text, so bytes are
compared inside every hash group, also against parts that occur once, and a part that
very many texts hold is one row per task before the shuffle. Where a hash belongs to
one text, places find their group by hash alone. Places to remove return to their
texts by id.

Parts of one line are never removed, nor blank ones. Defined results: null texts
stay null; a row is known by id and content, so rows that repeat an id and its
text count as one and change alike; rows without an id keep their whole text and
their parts don't count; an empty table gives an empty result; other columns
are passed by.
"""

from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import small_batches, stage, unstage

WINDOW = 2
SPREAD = 3
MIN_LINES = 2
FACTOR = 0x9E3779B97F4A7C15
MASK = 2**64 - 1


def content_hash(part: str) -> bytes:
    return xxhash.xxh3_128_digest(part)


def chunk_ends(lines: list[str]) -> list[int]:
    """Line numbers after which chunks end; the last is the number of lines."""
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    ends, rolling, out = [], 0, pow(FACTOR, WINDOW, 2**64)
    for number, value in enumerate(hashes, 1):
        rolling = (rolling * FACTOR + value) & MASK
        if number > WINDOW:
            rolling = (rolling - out * hashes[number - WINDOW - 1]) & MASK
        # The high bits mix all lines of the window.
        if number >= WINDOW and (rolling >> 33) % SPREAD == 0:
            ends.append(number)
    if not ends or ends[-1] != len(lines):
        ends.append(len(lines))
    return ends


def chunks(text: str) -> list[tuple[int, int, str]]:
    """First line, number of lines and text of each chunk; joined by line ends
    they are the text."""
    lines = text.split("\n")
    ends = chunk_ends(lines)
    return [(a, b - a, "\n".join(lines[a:b])) for a, b in zip([0, *ends], ends)]


def _removable(text: str) -> Iterator[tuple[int, str]]:
    return ((first, part) for first, n, part in chunks(text) if n >= MIN_LINES and not part.isspace())


def _spans(lines: list[str]) -> list[tuple[int, int]]:
    """First and last line of every two lines that follow each other, but for blank ones between."""
    full = [number for number, line in enumerate(lines) if line and not line.isspace()]
    return list(zip(full, full[1:]))


def _pairs(text: str) -> Iterator[tuple[int, str]]:
    """First line and text of every pair."""
    lines = text.split("\n")
    return ((first, "\n".join(lines[first : last + 1])) for first, last in _spans(lines))


def _part_rows(parts_of: Callable[[str], Iterator[tuple[int, str]]], hash_of: Callable[[str], bytes]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, signs, firsts, spans, hashes, parts = [], [], [], [], [], []
            for id_, sign, text in zip(batch["id"], batch["sign"], batch["text"]):
                for first, part in parts_of(text):
                    ids.append(id_)
                    signs.append(sign)
                    firsts.append(first)
                    spans.append(part.count("\n"))
                    hashes.append(hash_of(part))
                    parts.append(part)
            yield pd.DataFrame({
                "id": pd.Series(ids, dtype=batch["id"].dtype), "sign": pd.Series(signs, dtype="int64"),
                "first": pd.Series(firsts, dtype="int64"), "span": pd.Series(spans, dtype="int32"),
                "hash": pd.Series(hashes, dtype="object"), "part": pd.Series(parts, dtype="object"),
            })

    return rows


def repeated_parts(
    rows: DataFrame, parts_of: Callable[[str], Iterator[tuple[int, str]]], hash_of: Callable[[str], bytes]
) -> DataFrame:
    """From (id, sign, text): (id, sign, first) of each part that stands elsewhere
    too, but not of its first place, nor of a pair that overlaps that."""
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, sign bigint, first bigint, span int, hash binary, part string"
    parts = rows.filter("id is not null and text is not null").mapInPandas(_part_rows(parts_of, hash_of), schema)
    place = F.struct("id", "sign", "first")
    texts = parts.groupBy("hash", "part").agg(F.min(place).alias("kept"), F.max(place).alias("last"))
    # All texts of a hash count, those that occur once as well.
    by_hash = texts.groupBy("hash").agg(
        F.count("*").alias("n_texts"), F.min("kept").alias("kept"), F.max(F.expr("kept <> last")).alias("again")
    )
    groups = stage(by_hash.filter("again"), "line-groups")
    clash = groups.filter("n_texts > 1").select("hash")
    met = parts.drop("part").join(groups.filter("n_texts = 1").select("hash", "kept"), "hash")
    if not clash.isEmpty():
        apart = texts.filter("kept <> last").join(clash, "hash", "left_semi").select("hash", "part", "kept")
        met = met.unionByName(parts.join(apart, ["hash", "part"]).drop("part"))
    after = F.struct("kept.id", "kept.sign", (F.col("kept.first") + F.col("span")).alias("first"))
    return met.filter((place != F.col("kept")) & (place != after)).select("id", "sign", "first").distinct()


def without(text: str | None, gone) -> tuple[str | None, int]:
    """The text without the chunks that begin at some lines, and their number."""
    if text is None or gone is None or not len(gone):
        return text, 0
    places = set(gone)
    kept = [part for first, _, part in chunks(text) if first not in places]
    return "\n".join(kept), len(places)


def _hashed(hash_of: Callable[[str], bytes]):
    """Texts to the hashes of their chunks and pairs; a pair knows the first line of the chunk it lies in."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for id_, sign, text in zip(batch["id"], batch["sign"], batch["text"]):
                own = {}
                for first, n, part in chunks(text):
                    if n >= MIN_LINES and not part.isspace():
                        found.append((id_, sign, True, first, n - 1, hash_of(part), None))
                        own.update(dict.fromkeys(range(first, first + n), first))
                for first, part in _pairs(text):
                    span, chunk = part.count("\n"), own.get(first)
                    inside = chunk is not None and own.get(first + span) == chunk
                    found.append((id_, sign, False, first, span, hash_of(part), chunk if inside else None))
            frame = pd.DataFrame(found, columns=["id", "sign", "is_chunk", "first", "span", "hash", "chunk"])
            yield frame.astype({"id": batch["id"].dtype, "chunk": "Int64"})

    return rows


def _repeated(parts: DataFrame) -> DataFrame:
    """The places of the hashes that stand somewhere else too, and whether they are copies of an earlier place."""
    place = F.struct("id", "sign", "first")
    groups = parts.groupBy("hash").agg(F.min(place).alias("kept"), F.max(place).alias("last"))
    met = parts.join(groups.filter("kept <> last").drop("last"), "hash")
    after = F.struct("kept.id", "kept.sign", (F.col("kept.first") + F.col("span")).alias("first"))
    copy = (place != F.col("kept")) & (place != after)
    return met.select("id", "sign", "is_chunk", "first", "span", "hash", copy.alias("copy"))


def _part_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash and text of places of a text."""
    for batch in batches:
        found = []
        for text, places in zip(batch["text"], batch["places"]):
            lines = text.split("\n")
            found += [(p["hash"], "\n".join(lines[p["first"] : p["first"] + p["span"] + 1])) for p in places]
        yield pd.DataFrame(found, columns=["hash", "part"])


def anchored_places(rows: DataFrame, hash_of: Callable[[str], bytes]) -> DataFrame:
    """From (id, sign, text): per text the places of its repeated chunks, and of repeated pairs outside of copied chunks."""
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, sign bigint, is_chunk boolean, first bigint, span int, hash binary, chunk bigint"
    hashed = stage(rows.filter("id is not null and text is not null").mapInPandas(_hashed(hash_of), schema), "line-hashes")
    anchors = stage(_repeated(hashed.filter("is_chunk")), "line-anchors")
    copied = anchors.filter("copy").select("id", "sign", F.col("first").alias("chunk")).distinct()
    # Of a pair, no first place of all lies in a copied chunk.
    pairs = _repeated(hashed.filter("not is_chunk").join(copied, ["id", "sign", "chunk"], "left_anti"))
    places = F.array_sort(F.collect_set(F.struct("is_chunk", "first", "span", "hash", "copy"))).alias("places")
    found = stage(anchors.unionByName(pairs).groupBy("id", "sign").agg(places), "line-places")
    unstage(hashed)
    unstage(anchors)
    return found


def without_runs(text: str | None, places) -> tuple[str | None, int]:
    """The text without the lines of copied chunks' and other copied pairs, and their number."""
    copies = [p for p in places if p["copy"]] if text is not None and places is not None else []
    if not copies:
        return text, 0
    lines = text.split("\n")
    spans = _spans(lines)
    starts = {p["first"] for p in copies if not p["is_chunk"]}
    chunk = {line: p["first"] for p in copies if p["is_chunk"] for line in range(p["first"], p["first"] + p["span"] + 1)}
    starts.update(a for a, b in spans if a in chunk and chunk.get(b) == chunk[a])
    return without_pairs(text, starts)


def without_pairs(text: str | None, gone) -> tuple[str | None, int]:
    """The text without the lines of the pairs that begin at some lines, and their number."""
    if text is None or gone is None or not len(gone):
        return text, 0
    lines = text.split("\n")
    last = dict(_spans(lines))
    places = {line for first in gone for line in range(first, last[first] + 1)}
    kept = [line for number, line in enumerate(lines) if number not in places]
    return "\n".join(kept) if any(line and not line.isspace() for line in kept) else "", len(places)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[str], bytes] = content_hash
) -> DataFrame:
    """All columns of ``docs`` with the text that stays, and n_removed (chunks),
    which replaces a column of that name."""
    columns, named = _named(docs, id_col, text_col)
    return _cut(columns, _with_gone(named, repeated_parts(named.drop("row"), _removable, hash_of)), text_col, without)


def run_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[str], bytes] = content_hash
) -> DataFrame:
    """As ``line_dedup``, but without the lines of all shared runs; n_removed counts lines."""
    columns, named = _named(docs, id_col, text_col)
    places = anchored_places(named.drop("row"), hash_of)
    joined = stage(named.select("row", "id", "sign").join(places, ["id", "sign"], "left"), "line-rows")
    repeats = joined.filter("places is not null").select(F.col("row")[text_col].alias("text"), "places")
    parts = repeats.mapInPandas(_part_bytes, "hash binary, part string")
    clash = parts.groupBy("hash").agg(F.min("part").alias("a"), F.max("part").alias("z")).filter("a <> z")
    if not clash.isEmpty():
        gone = repeated_parts(named.drop("row"), _pairs, hash_of)
        return _cut(columns, _with_gone(named, gone), text_col, without_pairs)
    return _cut(columns, joined.withColumnRenamed("places", "gone"), text_col, without_runs)


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[list[str], DataFrame]:
    """Columns that are passed by, and the rows with id, text and a hash of it."""
    columns = [c for c in docs.columns if c != "n_removed"]
    named = small_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    named = named.select("row", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"))
    return columns, named.withColumn("sign", F.xxhash64("text"))


def _with_gone(named: DataFrame, gone: DataFrame) -> DataFrame:
    firsts = gone.groupBy("id", "sign").agg(F.collect_list("first").alias("gone"))
    return named.drop("text").join(firsts, ["id", "sign"], "left")


def _cut(columns: list[str], joined: DataFrame, text_col: str, cut: Callable) -> DataFrame:
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            done = [cut(t, g) for t, g in zip(texts, places)]
            yield pd.DataFrame(done, columns=["text", "n_removed"])

    kept = F.pandas_udf(keep, "text string, n_removed bigint")
    found = joined.withColumn("found", kept(F.col("row")[text_col], F.col("gone")))
    return found.select(
        *(F.col("found.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns),
        F.col("found.n_removed").alias("n_removed"),
    )
