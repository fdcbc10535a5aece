"""Token counts by a counting transducer that is compiled from a vocabulary of ranked merges.

**Transducer.** A text's tokens are fixed by neighbours alone: a row of tokens is the tokenizer's
answer if and only if every token and every two neighbours are the answer for their own text (a
merge across a boundary would be the best one there in the short text too). So the last token
of a prefix is the one piece at its end that may stand behind the last token of what is before
it. A state holds the longest end of the text that begins some piece, and for each cut of that end
the last token before the cut and the tokens lost or won since. A transition reads one character and
is annotated with the change of the number of tokens. Transitions are compiled when
first met, from the pieces and their ranks, and remembered; so is the sum over a word, where every space
behind another character is a boundary (below). Characters without a piece are their UTF-8 bytes.

**State maps.** Two characters that no piece contains side by side are a boundary in every text,
and behind it nothing depends on what came before. What a chunk does to any state is then: its
`head` up to its first boundary, still to be read; `emitted` tokens behind it; the `state` at its end. Such
maps compose associatively (`then`). Texts longer than a chunk become rows of chunks that
are dealt over all tasks; their maps are composed in a tree of groups of `FAN` neighbours.

Defined cases: null and empty texts have 0 bytes and tokens; every row gets its own answer, so repeated rows
and repeated doc_ids (null ones too) stay and get equal counts for equal texts; nothing is ranked, so there are no ties; an empty
table gives an empty result; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm.text import PIECE

#: Transitions, and words, that a Python worker keeps; beyond it they are compiled anew.
REMEMBERED = 500_000
#: Neighbouring state maps that one composition takes.
FAN = 64
_GAP = "▁"
_NONE = float("-inf")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # kinds of pieces, fixed by the file format

#: A state as a value: an end of the text, then for each of its cuts (nearest first) the token before it and the
#: number of tokens up to it, less that of the whole; None where no piece can start.
State = tuple[str, tuple[tuple[str, int] | None, ...]]
FRESH: State = ("", (("", 0),))


@dataclass
class StateMap:
    """What a chunk does. Without a boundary (`state` is None) the whole chunk is `head`."""

    head: str
    emitted: int = 0
    state: State | None = None


class Transducer:
    """Counting transducer over pieces and their ranks (higher merges first)."""

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks
        self.prefixes = {piece[:i] for piece in ranks for i in range(1, len(piece) + 1)}
        self.touching = {piece[i : i + 2] for piece in ranks for i in range(len(piece) - 1)}
        if any(c not in ranks for piece in ranks for c in piece):
            raise ValueError("every character of a piece must be a piece")
        closed = all(pair[0] == _GAP or pair[1] != _GAP for pair in self.touching)
        self.words = re.compile(f"{_GAP}*[^{_GAP}]+|{_GAP}+" if closed else r"(?s:.+)")
        self.forget()

    @classmethod
    def of_model(cls, path: str) -> Transducer:
        """The transducer of a sentencepiece model of kind BPE with byte fallback and no normalisation."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
        if not plain or norm.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("the model must add a space in front and change nothing else")
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback")
        if {p.type for p in model.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("the model has pieces that are set or taken out by hand")
        return cls({p.piece: p.score for p in model.pieces if p.type == _NORMAL})

    def forget(self) -> None:
        self.numbers: dict[State, int] = {FRESH: 0}
        self.states: list[State] = [FRESH]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.allowed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}
        self.size = 0

    def merged(self, text: str) -> list[str]:
        """Tokens of a short text, by the merges themselves: best rank first, leftmost of equal ones."""
        parts, get = list(text), self.ranks.get
        ranked = [get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranked and (best := max(ranked)) > _NONE:
            i = ranked.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranked[i]
            if i:
                ranked[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            if i < len(ranked):
                ranked[i] = get(parts[i] + parts[i + 1], _NONE)
        return parts

    def neighbours(self, a: str, b: str) -> bool:
        """Whether token `b` may stand behind token `a` (empty: a boundary)."""
        known = self.allowed.get((a, b))
        if known is None:
            known = self.merged(a + b) == ([a, b] if a else [b])
            self.allowed[a, b] = known
        return known

    def number(self, state: State) -> int:
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return at

    def compiled(self, at: int, c: str) -> tuple[int, int]:
        """The transition of a state by a character: next state and change of the number of tokens."""
        end, cuts = self.states[at]
        if end and end[-1] + c not in self.touching:
            end, cuts = FRESH
        if c not in self.ranks:
            move = 0, len(c.encode("utf-8", "replace"))
        else:
            end += c
            for length, cut in enumerate(cuts, 1):
                token = end[-length:]
                if cut and token in self.ranks and self.neighbours(cut[0], token):
                    break
            else:
                raise AssertionError(f"no token ends {end!r}")
            change = cut[1] + 1
            kept = [(token, 0)]
            while end not in self.prefixes:
                end = end[1:]
            for i, cut in enumerate(cuts[: len(end)], 1):
                kept.append((cut[0], cut[1] - change) if cut and end[-i:] in self.prefixes else None)
            move = self.number((end, tuple(kept))), change
        self.moves[at][c] = move
        self.size += 1
        return move

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Reads a text (spaces as the gap sign): the state behind it and the change of the number of tokens."""
        at, moves, total = self.number(state), self.moves, 0
        for c in text:
            move = moves[at].get(c)
            if move is None:
                move = self.compiled(at, c)
                if self.size > REMEMBERED:
                    state = self.states[move[0]]
                    self.forget()
                    moves = self.moves
                    move = self.number(state), move[1]
            at, change = move
            total += change
        return self.states[at], total

    def word(self, word: str) -> int:
        """Tokens from a boundary to the end of a word, which is the next boundary."""
        total = self.run(FRESH, word)[1]
        if len(word) <= 64:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = total
        return total

    def behind(self, text: str) -> tuple[State, int]:
        """As `run` from a boundary, with the sums of words already met."""
        words, known, total = self.words.findall(text), self.known, 0
        last = words.pop() if words else ""
        for word in words:
            total += known[word] if word in known else self.word(word)
            known = self.known
        state, change = self.run(FRESH, last)
        return state, total + change

    def count(self, text: str) -> int:
        """Tokens of a whole text; a space is put in front."""
        return self.behind(_GAP + text.replace(" ", _GAP))[1] if text else 0

    def chunk(self, text: str, first: bool) -> StateMap:
        """The state map of a chunk; the first chunk of a text starts at a boundary."""
        text = text.replace(" ", _GAP)
        if first:
            state, emitted = self.behind(_GAP + text)
            return StateMap("", emitted, state)
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.touching:
                state, emitted = self.behind(text[i:])
                return StateMap(text[:i], emitted, state)
        return StateMap(text)

    def then(self, a: StateMap, b: StateMap) -> StateMap:
        """First `a`, then `b`."""
        if a.state is None and not (a.head and b.head and a.head[-1] + b.head[0] not in self.touching):
            return StateMap(a.head + b.head, b.emitted, b.state)
        state, emitted = self.run(a.state or FRESH, b.head)
        return StateMap(a.head, a.emitted + emitted + b.emitted, b.state or state)


_loaded: dict[str, Transducer] = {}


def transducer(model: str) -> Transducer:
    if model not in _loaded:
        _loaded[model] = Transducer.of_model(model)
    return _loaded[model]


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def _cuts(data: bytes, chunk: int) -> list[int]:
    """Ends of chunks of at least `chunk` bytes, between characters."""
    out, at = [], 0
    while at < len(data):
        at = min(at + chunk, len(data))
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        out.append(at)
    return out


def _whole(docs: DataFrame, model: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            rows = [(len(t), machine.count(t.decode("utf-8", "replace"))) for t in _texts(batch.column(1))]
            columns = np.array(rows, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_bytes", "n_tokens"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return docs.mapInArrow(count, schema)


def _chunked(docs: DataFrame, model: str, chunk: int) -> DataFrame:
    """Counts of long texts: chunks as rows, their maps composed in a tree.

    Equal rows share their chunks; `copies` brings them back at the end.
    """
    identity = docs.select("doc_id").schema.add("text_id", "string").add("n_bytes", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in enumerate(_texts(batch.column(2))):
                at = 0
                for place, to in enumerate(_cuts(data, chunk)):
                    keys = [batch.column(i).slice(row, 1) for i in range(2)]
                    rest = [pa.array([x], t) for x, t in ((len(data), pa.int64()), (place, pa.int64()), (data[at:to], pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*keys, *rest], ["doc_id", "text_id", "n_bytes", "place", "chunk"])
                    at = to

    def map_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            chunks = zip(_texts(batch.column("chunk")), batch.column("place").to_pylist(), strict=True)
            maps = [machine.chunk(data.decode("utf-8", "replace"), place == 0) for data, place in chunks]
            columns = [pa.array([m.head for m in maps], pa.string()), pa.array([m.emitted for m in maps], pa.int64()),
                       pa.array([None if m.state is None else repr(m.state) for m in maps], pa.string())]
            kept = batch.select(["doc_id", "text_id", "n_bytes", "place", "copies"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "head", "emitted", "state"])

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        machine = transducer(model)
        group = group.sort_values("place", ignore_index=True)
        maps = [StateMap(h, int(e), _state(s)) for h, e, s in group[["head", "emitted", "state"]].itertuples(index=False)]
        while len(maps) > 1:
            maps = [machine.then(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        state = None if maps[0].state is None else repr(maps[0].state)
        return group.head(1).assign(place=group["place"] // FAN, head=maps[0].head, emitted=maps[0].emitted, state=state)

    keyed = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_id"), "text")
    rows = keyed.mapInArrow(cut, _with(identity, place="long", chunk="binary"))
    rows = rows.groupBy("doc_id", "text_id", "n_bytes", "place").agg(F.first("chunk").alias("chunk"), F.count("*").alias("copies"))
    schema = _with(identity, place="long", copies="long", head="string", emitted="long", state="string")
    maps = rows.mapInArrow(map_of, schema)
    most = -(-(2**31) // chunk)  # chunks of the longest text that Spark can hold
    while most > 1:
        maps = maps.groupBy("doc_id", "text_id", (F.col("place") / FAN).cast("long")).applyInPandas(composed, schema)
        most = -(-most // FAN)
    again = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return maps.select("doc_id", "n_bytes", F.col("emitted").alias("n_tokens"), again.alias("copy")).drop("copy")


def _with(schema, **fields):
    schema = type(schema)(list(schema.fields))
    for name, kind in fields.items():
        schema = schema.add(name, kind)
    return schema


def _state(text: str | None) -> State | None:
    return ast.literal_eval(text) if isinstance(text, str) else None


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = PIECE) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    `model` is the path of a sentencepiece model on every worker. Texts of more than `chunk` bytes are read by many tasks.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    long: Column = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    counted = _whole(docs.where(~long), model).unionByName(_chunked(docs.where(long), model, chunk))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
