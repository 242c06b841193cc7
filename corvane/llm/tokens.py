"""Encoding with public tokenizers: memoised by unit, and overlap resynchronisation for huge texts.

A *unit* is a blank with the run of characters up to the next blank.  Where a vocabulary provably has
no token that crosses from a non-blank into a blank, encoding a text equals encoding its units one by
one, so each distinct unit is encoded once and kept in a bounded cache.  Texts for which that proof does
not hold (double white space, the tokenizer's own blank mark, special strings) go to the library whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corvane.llm import common as C

#: Units kept by a Python worker: about 100 MB; the cache starts anew when full.
CACHE_UNITS = 500_000
#: Units kept in Arrow arrays, which are indexed anew for each block of texts: some 10 MB.
KNOWN_UNITS = 200_000
_LEAD = np.zeros(256, bool)  # may begin a white-space character
_LEAD[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_TAIL = _LEAD.copy()  # may end one
_TAIL[0x80:0xC0] = True
_TAIL[0xC2:] = False


def doubled_spaces(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row whether a blank may stand between two white-space characters or at an end."""
    if not len(raw):
        return np.zeros(len(at) - 1, bool)
    out = np.zeros(len(at) - 1, bool)
    blank = np.flatnonzero(raw[1:-1] == 32) + 1
    bad = blank[_LEAD[raw[blank + 1]] & _TAIL[raw[blank - 1]]]
    out[np.searchsorted(at, bad, "right") - 1] = True
    full = np.flatnonzero(at[1:] > at[:-1])
    out[full] |= _LEAD[raw[at[full]]] | _TAIL[raw[at[full + 1] - 1]] & (raw[at[full + 1] - 1] < 128)
    return out


class Memo(dict):
    """unit (without its blank) -> what `encode_units` gives for it."""

    def __init__(self, encode_units: Callable[[list[str]], list]) -> None:
        super().__init__()
        self.encode_units = encode_units

    def learn(self, units: list[list[str]]) -> None:
        every = set().union(*units)
        new = [x for x in every if x not in self]
        if len(self) + len(new) > CACHE_UNITS:
            self.clear()
            new = list(every)
        if new:
            self.update(zip(new, self.encode_units(new)))


class ByteBpe:
    """ids of the byte-level BPE in a `tokenizers` file.  Its words come from the pattern
    ` ?letters| ?digits| ?others|white space`, so a word never crosses from a non-blank into a blank that
    a non-blank follows.  Units are merged by tiktoken where the same vocabulary is given as ranks,
    which is several times faster, else by the library itself."""

    def __init__(self, path: str, ranks_path: str | None = None) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known, self.coded = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.blank_first = np.array([x[:1] == " " for x in map(self._text, range(self.library.get_vocab_size()))], bool)
        self.ranks = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _text(self, i: int) -> str:
        return self.library.decode([i], skip_special_tokens=False)

    def _plain(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _units(self, units: pa.Array) -> pa.Array:
        """All units in one text, each after its blank: a token that starts with a blank starts a unit."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(units)], units), pa.scalar(" ", units.type))[0].as_py()
        ids = self._plain(" " + joined)
        cut = np.append(np.flatnonzero(self.blank_first[ids]), len(ids)) * 4
        assert len(cut) == len(units) + 1
        return pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(cut), pa.py_buffer(ids)])

    def _coded(self, units: pa.Array) -> pa.Array:
        """The ids of distinct units; those that are not known yet are encoded and kept."""
        at = pc.index_in(units, value_set=self.known)
        new = units.filter(at.is_null())
        if not len(new):
            return self.coded.take(at)
        both = pa.concat_arrays([self.coded, self._units(new)])
        place = at.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(place), len(self.known) - 1 + np.cumsum(np.isnan(place)), place).astype(np.int64)
        found = both.take(pa.array(place))
        if len(both) > KNOWN_UNITS:
            self.known, self.coded = units, found
        else:
            self.known, self.coded = pa.concat_arrays([self.known, new]), both
        return found

    def encode_flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and where each text's begin; nulls are empty.

        Arrow tells the units apart and deals the ids of each distinct one to its places.  A text's first word
        has no blank before it, and odd texts go whole: their ids are entries of their own behind the units'."""
        column = column.fill_null("")
        odd = doubled_spaces(*C.text_buffer(column))
        for k in np.flatnonzero(pc.match_substring(column, "<").to_numpy(zero_copy_only=False)).tolist():
            odd[k] |= self.special.search(column[k].as_py()) is not None
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", column), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(first[0], first[-1] - first[0])
        first -= first[0]
        own = [self._plain(x).tobytes() if x else b"" for x in words.take(pa.array(first[:-1])).to_pylist()]
        for k in np.flatnonzero(odd).tolist():
            own[k] = np.array(self.library.encode(column[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        words = words.dictionary_encode()
        units = words.dictionary.cast(pa.large_string())
        code = words.indices.to_numpy().astype(np.int64)
        code[first[:-1]] = np.arange(len(units), len(units) + len(own))
        dealt = pa.concat_arrays([self._coded(units), pa.array(own, pa.large_binary())]).take(pa.array(code))
        _, edges, data = dealt.buffers()
        edges = np.frombuffer(edges, np.int64)[dealt.offset : dealt.offset + len(dealt) + 1] // 4
        ids = np.frombuffer(data, "<u4")[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, "<u4")
        return ids, edges[first] - edges[0]

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a column, as little-endian unsigned 32-bit numbers."""
        ids, at = self.encode_flat(column)
        return [ids[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())]

    @functools.cached_property
    def sentence_ends(self) -> np.ndarray:
        """For each id whether a sentence or line may end after it."""
        n = self.library.get_vocab_size()
        ends = [self._text(i) or " " for i in range(n)]
        return np.array([x[-1] in ".!?\n" or "\n" in x for x in ends], bool)


class Pieces:
    """Token counts of a sentencepiece model.  BPE only ever joins neighbours into a piece of the vocabulary,
    so where no piece holds a non-blank followed by a blank, no merge crosses such a place and every such
    place is a stable boundary."""

    BLANK = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.proven = not any(re.search(f"[^{self.BLANK}]{self.BLANK}", p) for p in pieces)
        # The normaliser must keep blanks and letters as they are, and put one blank before a text.
        probe = "a  b\tc "
        self.proven &= "".join(self.library.encode(probe, out_type=str)) == "▁a▁▁b<0x09>c▁"
        self.longest = max(len(p) for p in pieces)
        self.blank_first = np.array([p.startswith(self.BLANK) for p in pieces], bool)
        self.memo = Memo(self._units)

    def _units(self, units: list[str], together: int = 24) -> list[int]:
        """A few units in one text: a piece that starts with a blank starts a unit."""
        texts = [" ".join(units[i : i + together]) for i in range(0, len(units), together)]
        out: list[int] = []
        for ids in self.library.encode(texts, num_threads=1):
            cut = np.append(np.flatnonzero(self.blank_first[ids]), len(ids))
            out += np.diff(cut).tolist()
        assert len(out) == len(units)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library gives them."""
        proven, mark = self.proven, self.BLANK
        plain = [t.split(" ") if proven and t and "  " not in t and t[0] != " " and t[-1] != " " and mark not in t else None for t in texts]
        self.memo.learn([s for s in plain if s])
        get = self.memo.__getitem__
        rest = iter(self.library.encode([t for t, s in zip(texts, plain) if s is None], num_threads=1))
        return [sum(map(get, s)) if s is not None else len(next(rest)) for s in plain]

    def starts(self, chunk: bytes, at: int) -> np.ndarray:
        """Start of each token of a chunk, in bytes of the document; `at`: where the chunk starts."""
        found = self.library.encode(chunk.decode(), return_type="proto").pieces
        return np.fromiter((x.begin for x in found), np.int64, len(found)) + at


@functools.lru_cache(maxsize=1)
def byte_bpe(path: str, ranks_path: str | None = None) -> ByteBpe:
    """One coder a Python worker, whose cache serves all its tasks."""
    return ByteBpe(path, ranks_path)


@functools.lru_cache(maxsize=1)
def piece_counter(path: str) -> Pieces:
    return Pieces(path)


def count_huge(text: str, pieces: Pieces, chunk: int = 4096, overlap: int = 64) -> int:
    """Tokens of a long text, by overlapping chunks.

    The chunk in hand ends at `end`; the next starts `overlap` bytes before that.  Both are encoded with
    offsets.  They are spliced at a place in the overlap where both start a token and which is a stable
    boundary: a blank after a non-blank, which no piece crosses (see Pieces).  Where there is none the
    overlap doubles; when it reaches the last splice, the chunk in hand doubles instead, so a text without
    any stable boundary is encoded whole in the end."""
    raw = text.encode()
    n, blank = len(raw), pieces.BLANK.encode()

    def whole_character(i: int) -> int:
        while i < n and raw[i] & 0xC0 == 0x80:
            i += 1
        return min(i, n)

    total, begin, end = 0, 0, whole_character(chunk)  # the tokens before `begin` are counted
    starts = pieces.starts(raw[:end], 0)
    while end < n:
        width, splice = overlap, None
        while splice is None and end - width > begin:
            at = whole_character(end - width)
            stop = whole_character(end + chunk)
            after = pieces.starts(raw[at:stop], at)
            both = np.intersect1d(starts[starts > max(begin, at)], after)
            stable = [int(b) for b in both if b < end and raw[b] == 32 and raw[b - 1] != 32 and not raw.endswith(blank, 0, b)]
            splice = stable[len(stable) // 2] if stable else None
            width *= 2
        if splice is None:
            end = whole_character(begin + 2 * (end - begin))
            # The library puts a blank in front: at a splice it stands for the one that is there.
            starts = pieces.starts(raw[begin + 1 : end], begin + 1) if begin else pieces.starts(raw[:end], 0)
            continue
        total += int(((starts >= begin) & (starts < splice)).sum())
        begin, end, starts = splice, stop, after
    return total + int((starts >= begin).sum())


def token_counts(docs: DataFrame, path: str, limit: int = 4096, huge: int = 32_768) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; texts over `huge` characters go by overlapping
    chunks, so that no encoding is longer than a chunk and its overlap (unless a text has no stable boundary).

    A null text counts as empty, with no tokens; a null doc_id is kept; repeated rows each get a row; other
    columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_counter(path)
        for b in batches:
            column = b.column(1).fill_null("")
            _, at = C.text_buffer(column)
            for i, j in C.slices(at, 4 << 20):
                texts = column.slice(i, j - i).to_pylist()
                long = [len(t) > huge and pieces.proven for t in texts]
                plain = iter(pieces.counts([t for t, x in zip(texts, long) if not x]))
                n = [count_huge(t, pieces) if x else next(plain) for t, x in zip(texts, long)]
                size = (at[i + 1 : j + 1] - at[i:j]).astype(np.int64)
                counts = np.array(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(size), pa.array(counts), pa.array(counts > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
