"""Splitting texts that are longer than a token limit at natural boundaries, with overlap.

A text becomes a string of *marks*, one character per token, that says how strong the boundary behind the token is
(``h`` before a heading or fence, ``p`` paragraph, ``l`` line, ``s`` sentence, ``w`` white space, ``c`` between
characters, ``x`` inside a character). Pieces are then extracted from the marks by one regex with bounded quantifiers:
its alternatives, ordered by boundary strength, consume up to the limit, with the character as the last resort. Piece
starts look back by the overlap; offsets and texts follow with SQL array functions.

A cut between two tokens of a byte-pair encoding leaves both sides with the very same tokens, as no merge ever crossed it.
The one exception is white space that ends a piece: there it is one pre-token, in the text its last character may be one of
its own. The marks say by how many tokens such an end differs: one less is subtracted, anything else is no place to cut.
So ``n_tokens`` is what a piece has when it is encoded anew.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZERS, VOCABULARY, Encoder, in_groups, model_bytes, vocabulary

#: Tokens per stored part of a text; a piece is cut from the few parts it touches, so long texts cost no more per piece.
PART = 128
_BREAK = re.compile("[\n\r\x0b\x0c\x85  ]\\s*")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
# patterns that begin with one set of characters are searched for many times faster than those that begin with a repeat
_SENTENCE = re.compile("[.!?…؟।。！？｡](?:(?<=[.!?…؟।])[.!?…؟।]*[\"'”’»)\\]]*(?=\\s)|(?<=[。！？｡])[。！？｡]*[」』”’）]*)")
_SPACES_END = re.compile(r"[^\S ](?<=\s\s)(?=\S)")
_SECTION = re.compile("#{1,6}\\s|```|~~~|---|\\* \\* \\*")
_SECTION_STARTS = "#`~-*"


class _Marker(Encoder):
    """Remembers of each pre-token, two bytes a token, its marks (the first with the upper bit if it begins with white space) and the characters each token completes."""

    def __init__(self, model: bytes, pieces: list[bytes]):
        super().__init__(model)
        self.lengths = np.array([len(p) for p in pieces])
        self.known: dict[str, bytes] = {}
        self.lines: dict[str, int] = {"\n": 108, "\n\n": 112}

    def forget(self) -> None:
        super().forget()
        self.known.clear(), self.lines.clear()

    def learn(self, new: list[str]) -> None:
        super().learn(new)
        raw = np.frombuffer("".join(new).encode(), dtype=np.uint8)
        closes = np.append((raw[1:] & 0xC0) != 0x80, True)  # does a character end with this byte?
        ids = [self.seen[w] for w in new]
        stops = np.cumsum(self.lengths[np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64)]) - 1
        both = np.empty((len(stops), 2), dtype=np.uint8)
        both[:, 0] = np.where(closes[stops], 99, 120)
        both[:, 1] = np.diff(np.cumsum(closes)[stops], prepend=0)
        upto = np.cumsum([len(i) for i in ids])
        first = np.r_[0, upto[:-1]]
        both[first[np.array([w[0].isspace() for w in new])], 0] |= 128
        raw = both.tobytes()
        self.known.update((w, raw[a:b]) for w, a, b in zip(new, (2 * first).tolist(), (2 * upto).tolist()))

    def of(self, text: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marks (as bytes) and end offsets in characters of all tokens of a text of known pre-tokens."""
        both = np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.uint8).reshape(-1, 2)
        marks = both[:, 0] & 127
        marks[:-1][(both[1:, 0] > 127) & (marks[:-1] == 99)] = 119
        ends = np.cumsum(both[:, 1], dtype=np.int32)
        stops = np.array([m.end() for m in _SENTENCE.finditer(text)], dtype=np.int32)
        at = np.searchsorted(ends, stops)
        at = at[ends[np.minimum(at, len(ends) - 1)] == stops]
        marks[at[marks[at] != 120]] = 115
        breaks = [m.span() for m in _BREAK.finditer(text)]
        last = np.searchsorted(ends, np.array([b for _, b in breaks], dtype=np.int32), side="right") - 1
        while (inside := (last >= 0) & (marks[last] == 120)).any():
            last = last - inside
        found = []
        for (begin, end), k, stop in zip(breaks, last.tolist(), ends[last].tolist()):
            if k < 0 or stop <= begin:
                found.append(0)
            elif text[end : end + 1] in _SECTION_STARTS and _SECTION.match(text, end):
                found.append(104)
            else:
                run = text[begin:end]
                if run not in self.lines:
                    self.lines[run] = 112 if len(_LINE.findall(run)) > 1 else 108
                found.append(self.lines[run])
        found = np.array(found, dtype=np.uint8)
        marks[last[found > 0]] = found[found > 0]
        self.end_otherwise(text, marks, ends)
        return marks, ends

    def end_otherwise(self, text: str, marks: np.ndarray, ends: np.ndarray) -> None:
        """Mark the last tokens of white space that has another number of tokens where a text ends with it: a capital letter for one less, ``x`` else.

        A last space belongs to the next word, so no token ends with such white space.
        """
        runs = []
        for m in _SPACES_END.finditer(text):
            begin = m.start() - 1
            while begin and text[begin - 1].isspace():
                begin -= 1
            runs.append((begin, m.end()))
        if not runs:
            return
        begins, stops = np.array(runs).T
        last = np.searchsorted(ends, stops)
        whole = last + 1 - np.searchsorted(ends, begins, side="right")
        for k, n, (begin, stop) in zip(last.tolist(), whole.tolist(), runs):
            if ends[k] == stop:
                run = text[begin:stop]
                if run not in self.seen:
                    self.learn([run])
                less = n - len(self.seen[run])
                if less:
                    marks[k] = marks[k] - 32 if less == 1 else 120


def piece_pattern(limit: int, overlap: int) -> str:
    """Regex of the new tokens of each piece: up to ``limit`` in the first, up to ``limit - overlap`` in the others.

    A strong boundary is taken if it leaves the piece at least half full; before a cut between words, any sentence,
    line or paragraph end will do. The first piece has more tokens than the overlap, else the second would begin where it
    does and hold it whole.
    """

    def ways(most: int, start: str, least: int) -> list[str]:
        half = max(most // 2, least)
        return [
            rf"{start}.{{1,{most}}}+\z",  # fewer would not reach the end either
            rf"{start}.{{{half},{most - 1}}}[hp]",
            rf"{start}.{{{half},{most - 1}}}l",
            rf"{start}.{{{half},{most - 1}}}s",
            rf"{start}.{{{least},{most - 1}}}[hpls]",
            rf"{start}.{{{least},{most - 1}}}w",
            rf"{start}.{{{least},{most - 1}}}c",
            rf"{start}.{{{most}}}",
        ]

    return "|".join(ways(limit, r"\A", overlap) + ways(limit - overlap, r"(?!\A)", 0))


def marked(docs: DataFrame, least: int, tokenizers: str = TOKENIZERS, vocabulary_name: str = VOCABULARY) -> DataFrame:
    """``(doc_id, marks, raw, ends, parts)``, ``raw`` the marks as bytes for access by place (capital where a piece that ends there has one token less), of texts of more than ``least`` tokens; ``docs`` has ``doc_id`` and ``text``."""
    pieces = vocabulary(tokenizers, vocabulary_name)
    model = model_bytes(pieces)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = _Marker(model, pieces)
        for batch in batches:
            ids, marks, raw, ends, parts = [], [], [], [], []
            for group in in_groups([(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and len(t) * 4 > least]):
                for (key, text), words in zip(group, marker.pretokens([t for _, t in group])):
                    m, e = marker.of(text, words)
                    if len(m) > least:
                        plain = m | 32
                        cuts = [0, *e[PART - 1 : -1 : PART].tolist(), len(text)]
                        ids.append(key), marks.append(plain.tobytes()), raw.append(m.tobytes()), ends.append(e), parts.append([text[a:b] for a, b in zip(cuts, cuts[1:])])
            offsets = np.zeros(len(ends) + 1, dtype=np.int32)
            np.cumsum([len(e) for e in ends], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ends) if ends else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(marks, pa.binary()).cast(pa.string()), pa.array(raw, pa.binary()), lists, pa.array(parts, pa.list_(pa.string()))], names=["doc_id", "marks", "raw", "ends", "parts"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, marks string, raw binary, ends array<int>, parts array<string>")


def running_sums(lengths: Column, block: int = 128) -> Column:
    """0 and the running sums of an array, in blocks, as an array that grows element by element is copied each time."""
    of = lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    grown = lambda array, first: F.aggregate(array, F.array(first), lambda seen, k: F.concat(seen, F.array(F.element_at(seen, -1) + k)))
    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))
    sums = F.transform(numbers, lambda b: F.aggregate(of(b), F.lit(0), lambda a, k: a + k))
    blocks = F.flatten(F.transform(F.array(grown(sums, F.lit(0))), lambda bases: F.transform(numbers, lambda b: F.struct(b.alias("b"), F.get(bases, b).alias("base")))))
    inner = F.transform(blocks, lambda x: F.slice(grown(of(x["b"]), x["base"]), F.lit(2), F.lit(block)))
    return F.when(F.size(lengths) <= block, grown(lengths, F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), F.flatten(inner)))


def split_texts(docs: DataFrame, profiles: list[tuple[str, int, int]], tokenizers: str = TOKENIZERS, vocabulary_name: str = VOCABULARY) -> DataFrame:
    """Pieces ``(doc_id, profile, piece_no, start_token, n_tokens, overlap_tokens, boundary, piece)`` of too long texts.

    ``profiles``: ``(name, max_tokens, overlap_tokens)``; a text is split for each profile whose limit it exceeds,
    others (null, empty and short texts too) give no row. Pieces are numbered from 0, have at most ``max_tokens``
    tokens (``n_tokens``, as encoded anew) and begin ``overlap_tokens`` tokens before the end of the piece before; where that would fall inside a
    character, after that character. ``boundary`` is the mark behind the piece (``e``: end of the text). Repeated ids
    are split row by row. Without their overlap the pieces add up to the text.
    """
    for name, most, shared in profiles:
        if not 0 <= shared <= most - 4:  # a character may take four tokens
            raise ValueError(f"profile {name}: overlap {shared} must be at least four below the limit {most}")
    if not profiles:
        profiles = [("", 2**31 - 1, 0)]
    text_marks = marked(docs, min(p[1] for p in profiles), tokenizers, vocabulary_name)
    n = F.size("ends")
    element = lambda array, at: F.get(array, at)

    def pieces(name: str, most: int, shared: int) -> Column:
        runs = F.regexp_extract_all("marks", F.lit("(?s)" + piece_pattern(most, shared)), F.lit(0))
        stops = running_sums(F.transform(runs, lambda r: F.length(r)))

        def bounds(stop: Column) -> Column:
            def one(i: Column) -> Column:
                back = F.greatest(element(stop, i) - shared, F.lit(0))
                inside = lambda k: F.substr("raw", back + k, F.lit(1)) == F.lit(bytearray(b"x"))  # noqa: E731  of the k-th token from the one before
                # a start inside a character moves behind it
                skip = F.when((i == 0) | (back == 0) | ~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
                start = F.when(i == 0, 0).otherwise(F.least(back + skip, element(stop, i)))
                return F.struct(i.alias("n"), start.alias("start"), element(stop, i).alias("new"), element(stop, i + 1).alias("stop"))

            return F.transform(F.sequence(F.lit(0), F.size(stop) - 2), one)

        def piece(p: Column) -> Column:
            first, last = F.floor(p["start"] / PART).cast("int"), F.floor((p["stop"] - 1) / PART).cast("int")
            base = F.when(first == 0, 0).otherwise(element("ends", first * PART - 1))
            begin = F.when(p["start"] == 0, 0).otherwise(element("ends", p["start"] - 1))
            mark = F.substr("raw", p["stop"], F.lit(1)).cast("string")
            return F.struct(
                F.lit(name).alias("profile"), p["n"].alias("piece_no"), p["start"].alias("start_token"), (p["stop"] - p["start"] - F.when((p["stop"] < n) & (F.ascii(mark) < 97), 1).otherwise(0)).alias("n_tokens"),
                (p["new"] - p["start"]).alias("overlap_tokens"), F.when(p["stop"] == n, F.lit("e")).otherwise(F.lower(mark)).alias("boundary"),
                F.substr(F.array_join(F.slice("parts", first + 1, last - first + 1), ""), begin - base + 1, element("ends", p["stop"] - 1) - begin).alias("piece"),
            )

        cut = F.flatten(F.transform(F.array(stops), lambda stop: F.transform(bounds(stop), piece)))
        return F.when(n > most, cut)

    # the marks, offsets and parts of a text stay in its one row: only finished pieces are spread over rows
    every = F.flatten(F.filter(F.array(*[pieces(*p) for p in profiles]), lambda x: x.isNotNull()))
    return text_marks.select("doc_id", F.explode(every).alias("p")).select("doc_id", "p.*")
