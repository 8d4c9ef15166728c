"""Operator 10, SentencePiece encoding and decoding; giant texts by a max-plus scan.

The ids are those of the library for the same model, which merges pairs of
pieces. A sequence of pieces is what the merges give exactly if each two
neighbours, merged alone, stay as they are. So an encoding is a path whose steps
are pieces, weigh 0 where two neighbours are compatible and minus infinity where
they are not, and the best path is the only one above minus infinity.

Texts of up to ``CHUNK`` characters are encoded where they are read. A longer one
is cut anywhere into chunks. The state at a cut is the piece that runs up to it or
across it: where it begins and ends beside the cut. Each chunk yields a matrix
from the states at its left to those at its right. Matrices of neighbours are
combined in the max-plus product, pairwise, up to the whole text; going back
down, each product tells the state at its middle cut. Then every chunk traces its
own pieces from its two states, apart from all others.

No piece holds a space mark behind another character, so all paths meet at a
space: there a chunk's matrix is a column by a row, and the stretch between its
first and last space goes to the library. Only stretches without a space take the
step-by-step search, with no limit on their length.

Defined results: null and empty texts have no ids; a text's own U+2581 is a space
to the model, all other texts decode to themselves; repeated rows are encoded
each; an empty table gives an empty result; other columns are not read.
"""

from collections.abc import Iterator

import pandas as pd
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import small_batches, stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
SPACE = "▁"
#: Pairs of pieces a worker remembers; the memory is emptied beyond that.
REMEMBERED = 100_000
#: The state before a text: no piece.
START = (0, 0)

State = tuple[int, int]
Matrix = dict[State, dict[State, float]]


class Pieces:
    """A model's vocabulary and merges; one per worker."""

    def __init__(self, model: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = self.library.get_piece_size()
        special = (self.library.is_control, self.library.is_unknown, self.library.is_byte, self.library.is_unused)
        names = {k: self.library.id_to_piece(k) for k in range(size) if not any(f(k) for f in special)}
        if any(SPACE in name.lstrip(SPACE) for name in names.values()):
            raise ValueError("a piece of this model holds a space mark behind another character")
        self.score = {name: self.library.get_score(k) for k, name in names.items()}
        self.id = {name: k for k, name in names.items()}
        self.reach = max(map(len, names.values()))
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merges on a short text: always the best score, the first of equals."""
        parts = list(text)
        while True:
            best = max(
                ((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score),
                default=None,
            )
            if best is None:
                return parts
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]

    def compatible(self, left: str, right: str) -> bool:
        if (left, right) not in self.pairs:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[left, right] = self.merged(left + right) == [p for p in (left, right) if p]
        return self.pairs[left, right]

    def is_piece(self, text: str) -> bool:
        return text in self.score or len(text) == 1

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.library.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]

    def between_spaces(self, marked: str) -> list[int]:
        """Ids of a stretch that begins with a space mark."""
        return self.library.encode(marked[1:].replace(SPACE, " "))

    def step_by_step(self, text: str, begin: int, last: str, end: int) -> dict[int, tuple[int, str]]:
        """The last piece of the only encoding of text[begin:k], for every k up to
        ``end`` and for those beyond that a piece from before ``end`` reaches.

        ``last`` is the piece before ``begin``. Values are where the piece begins
        and the piece.
        """
        found = {begin: (begin, last)}
        for stop in range(begin + 1, min(len(text), end + self.reach) + 1):
            for start in range(max(begin, stop - self.reach), min(stop, end)):
                if start in found:
                    piece = text[start:stop]
                    if self.is_piece(piece) and self.compatible(found[start][1], piece):
                        found[stop] = (start, piece)
                        break
        return found


class Chunk:
    """Characters [low, high) of ``text``, which holds some more on both sides.

    ``first`` and ``final`` tell whether the whole text begins and ends here.
    """

    def __init__(self, pieces: Pieces, text: str, low: int, high: int, first: bool, final: bool) -> None:
        self.pieces, self.text, self.low, self.high = pieces, text, low, high
        self.first, self.final = first, final
        marks = [k for k in range(max(low, 1), high) if text[k] == SPACE and text[k - 1] != SPACE]
        if first:
            marks.insert(0, 0)
        self.head, self.tail = (marks[0], marks[-1]) if marks else (None, None)

    def states(self) -> list[State]:
        """Pieces that begin before the chunk and end in it or at its start, by
        their begin and end relative to the chunk."""
        if self.first:
            return [START]
        span = range(1, self.pieces.reach + 1)
        return [
            (-back, size - back)
            for back in span
            for size in range(back, self.pieces.reach + 1)
            if back <= self.low and self.low - back + size <= len(self.text)
            and self.pieces.is_piece(self.text[self.low - back : self.low - back + size])
        ]

    def _piece(self, state: State) -> str:
        return self.text[self.low + state[0] : self.low + state[1]]

    def _ends(self, found: dict[int, tuple[int, str]]) -> dict[State, float]:
        """States at the right of the chunk among the pieces of a search."""
        ends = {}
        for stop, (start, piece) in found.items():
            if stop >= self.high and start < self.high and piece:
                if not self.final or stop == self.high:
                    ends[start - self.high, stop - self.high] = 0.0
        return ends

    def _from(self, state: State, end: int) -> dict[int, tuple[int, str]]:
        return self.pieces.step_by_step(self.text, self.low + state[1], self._piece(state), end)

    def matrix(self) -> Matrix:
        """Best weights from the left states to the right ones; what is missing is
        minus infinity."""
        out = {}
        right = None
        if self.head is not None:
            right = self._ends(self.pieces.step_by_step(self.text, self.tail, "", self.high))
        for state in self.states():
            at = self.low + state[1]
            if self.head is not None and at <= self.head:
                if at == self.head or self.head in self._from(state, self.head):
                    out[state] = dict(right)
            elif at >= self.high:
                # The piece runs across the whole chunk, or up to its end.
                if not self.final or at == self.high:
                    out[state] = {(self.low + state[0] - self.high, at - self.high): 0.0}
            elif self.head is None or at <= self.high:
                out[state] = self._ends(self._from(state, self.high))
        return {state: ends for state, ends in out.items() if ends}

    def trace(self, left: State, right: State) -> list[int]:
        """Ids of the pieces that begin in the chunk, between two states."""
        at, stop = self.low + left[1], self.high + right[1]
        if self.high + right[0] < self.low:
            return []
        if self.head is not None and at <= self.head:
            before = self._back(self._from(left, self.head), at, self.head)
            middle = self.pieces.between_spaces(self.text[self.head : self.tail]) if self.tail > self.head else []
            after = self.pieces.step_by_step(self.text, self.tail, "", self.high)
            return before + middle + self._back(after, self.tail, stop)
        return self._back(self._from(left, self.high), at, stop)

    def _back(self, found: dict[int, tuple[int, str]], begin: int, stop: int) -> list[int]:
        pieces = []
        while stop > begin:
            stop, piece = found[stop]
            pieces.append(piece)
        return [i for piece in reversed(pieces) for i in self.pieces.ids(piece)]


def product(left: Matrix, right: Matrix) -> tuple[Matrix, dict[tuple[State, State], State]]:
    """The max-plus product, and for each of its entries the state in the middle."""
    out, middle = {}, {}
    for a, row in left.items():
        best: dict[State, float] = {}
        for m, weight in row.items():
            for b, more in right.get(m, {}).items():
                if b not in best or weight + more > best[b]:
                    best[b] = weight + more
                    middle[a, b] = m
        if best:
            out[a] = best
    return out, middle


def cuts(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """Left and right state of each chunk of a text."""
    levels, middles = [matrices], []
    while len(levels[-1]) > 1:
        row, found = levels[-1], []
        for k in range(0, len(row) - 1, 2):
            found.append(product(row[k], row[k + 1]))
        levels.append([m for m, _ in found] + row[len(found) * 2 :])
        middles.append([m for _, m in found])
    (left, ends), = levels[-1][0].items()
    states = [(left, max(ends, key=ends.get))]
    for found in reversed(middles):
        below = []
        for k, (a, b) in enumerate(states):
            below += [(a, found[k][a, b]), (found[k][a, b], b)] if k < len(found) else [(a, b)]
        states = below
    return states


_LOADED: dict[str, Pieces] = {}


def pieces_of(model: str) -> Pieces:
    """The model, read once per worker."""
    if model not in _LOADED:
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.replace(SPACE, " ").encode())


def cut_up(text: str, reach: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """Chunks of a text with ``reach`` more characters on both sides."""
    whole = marked(text)
    for number, low in enumerate(range(0, len(whole), CHUNK)):
        high, begin = min(low + CHUNK, len(whole)), max(0, low - reach)
        yield number, whole[begin : high + reach], low - begin, high - begin, low == 0, high == len(whole)


CHUNKS = "key string, number bigint, text string, low int, high int, first boolean, final boolean"
MATRIX = "array<struct<a:int,b:int,c:int,d:int>>"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per row: id, token_ids, n_tokens, round_trip (the ids decode to the text)."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    giant = F.coalesce(F.char_length("text") >= CHUNK, F.lit(False))

    def small(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        library = pieces_of(model).library
        for texts in batches:
            given = [text or "" for text in texts]
            ids = library.encode(given, num_threads=1)
            back = library.decode(ids, num_threads=1) if ids else []
            same = [a == b.replace(SPACE, " ") for a, b in zip(back, given)]
            yield pd.DataFrame({"token_ids": ids, "round_trip": same})

    coded = F.pandas_udf(small, "token_ids array<int>, round_trip boolean")
    direct = rows.filter(~giant).withColumn("coded", coded("text")).select("id", "coded.token_ids", "coded.round_trip")
    long = _encode_giants(rows.filter(giant), model)
    both = direct.unionByName(long)
    return both.select(F.col("id").alias(id_col), "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"), "round_trip")


def _encode_giants(rows: DataFrame, model: str) -> DataFrame:
    id_type = rows.schema["id"].dataType

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A key that a repeated task gives again: its partition and the row's number in it.
        reach, part, row = pieces_of(model).reach, TaskContext.get().partitionId(), 0
        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"]):
                key, digest, row = f"{part}-{row}", _digest(text), row + 1
                out = [(id_, digest, key, *chunk) for chunk in cut_up(text, reach)]
                frame = pd.DataFrame(out, columns=["id", "digest", "key", "number", "text", "low", "high", "first", "final"])
                yield frame.astype({"id": "object"})

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for batch in batches:
            out = []
            for row in batch.itertuples():
                matrix = Chunk(pieces, row.text, row.low, row.high, row.first, row.final).matrix()
                out.append([{"a": a[0], "b": a[1], "c": b[0], "d": b[1]} for a, ends in matrix.items() for b in ends])
            yield pd.DataFrame({"key": batch["key"], "number": batch["number"], "matrix": out})

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        matrices = []
        for cells in rows["matrix"]:
            matrix: Matrix = {}
            for c in cells:
                matrix.setdefault((c["a"], c["b"]), {})[c["c"], c["d"]] = 0.0
            matrices.append(matrix)
        ends = cuts(matrices)
        return pd.DataFrame({
            "key": rows["key"].to_numpy(), "number": rows["number"].to_numpy(),
            **{name: [e[i][j] for e in ends] for name, i, j in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))},
        })

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for batch in batches:
            ids = [
                Chunk(pieces, r.text, r.low, r.high, r.first, r.final).trace((r.a, r.b), (r.c, r.d))
                for r in batch.itertuples()
            ]
            yield pd.DataFrame({"key": batch["key"], "number": batch["number"], "ids": ids})

    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        library = pieces_of(model).library
        for ids, digests in batches:
            yield pd.Series([_digest(library.decode(list(map(int, i)))) == d for i, d in zip(ids, digests)], dtype=bool)

    chunks = stage(
        rows.withColumn("id", F.col("id").cast("string"))
        .mapInPandas(cut, f"id string, digest binary, {CHUNKS}")
        .repartition(F.col("key"), F.col("number")),
        "chunks",
    )
    matrices = chunks.select(*(c for c in chunks.columns if c not in ("id", "digest"))).mapInPandas(
        transfer, f"key string, number bigint, matrix {MATRIX}"
    )
    ends = matrices.groupBy("key").applyInPandas(combine, "key string, number bigint, a int, b int, c int, d int")
    traced = chunks.drop("id", "digest").join(ends, ["key", "number"]).mapInPandas(
        trace, "key string, number bigint, ids array<int>"
    )
    # An array holds the chunks of one text only.
    whole = traced.groupBy("key").agg(F.flatten(F.sort_array(F.collect_list(F.struct("number", "ids")))["ids"]).alias("token_ids"))
    heads = chunks.filter("number = 0").select("id", "key", "digest")
    checked = F.pandas_udf(check, "boolean")
    return heads.join(whole, "key").select(F.col("id").cast(id_type).alias("id"), "token_ids", checked("token_ids", "digest").alias("round_trip"))


def decode(encoded: DataFrame, ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """All columns and ``text`` (replaced if it is there); null ids give a null text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        library = pieces_of(model).library
        for ids in batches:
            yield pd.Series([None if i is None else library.decode(list(map(int, i))) for i in ids], dtype="object")

    return encoded.withColumn("text", F.pandas_udf(run, "string")(F.col(ids_col)))
