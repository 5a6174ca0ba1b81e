"""Token ids of whole texts through the tokenizers library, with repeated words encoded once.

Both vocabularies split a text into pre-tokens that never reach across white space, but for a
single leading space. A slice of texts is therefore cut at single spaces and line ends, as Arrow arrays; each
distinct piece of the slice goes through the library once, and the ids are gathered by numpy. Words of
letters alone are one pre-token each, so they go straight to the library's merges, and their ids are kept for
later slices. The kept words are bounded (`KEPT`); a full store is emptied by halves, so results never depend on it.

Texts whose cut is not certain (three white characters in a row, two at the end, special strings, the
mark itself) go through the library whole.

Defined results: ids_of gives one value for each text, equal to the library's encode of the whole text without
added special tokens; an empty text has no ids; a text of any length is worked on whole.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabloom.llm.common import WHITE

#: Most words that one Python worker keeps, and the longest piece (characters) worth keeping.
KEPT, KEPT_LENGTH = 1_000_000, 64
#: Punctuation that may stand behind a word; a run of it is a pre-token of its own.
_BEHIND = ".,;:!?"
#: Bytes of text that are worked on at a time.
SLICE = 8 << 20
#: What pieces are cut at, once it stands before each space and around each line end.
_MARK = "\x00"
#: Letters below this code point are letters in every version of Unicode that a library may follow.
_SETTLED = "԰"


class Kept[V]:
    """A bounded store by piece: two halves, the older of which goes when the younger is full."""

    def __init__(self, most: int = KEPT):
        self.most, self.young, self.old = max(1, most // 2), {}, {}

    def all(self, pieces: list[str], learn: Callable[[list[str]], Iterable[V]]) -> list[V]:
        """The values of all pieces (which are distinct); learn gives those of the ones that are not kept."""
        young, old = self.young, self.old
        out = [*map(young.get, pieces)]
        missing = [n for n, v in enumerate(out) if v is None] if None in out else []
        new = []
        for n in missing:
            if (v := old.get(pieces[n])) is None:
                new.append(n)
            else:
                out[n] = young[pieces[n]] = v
        for n, v in zip(new, learn([pieces[n] for n in new]), strict=True):
            out[n] = v
            if len(pieces[n]) <= KEPT_LENGTH:
                young[pieces[n]] = v
        if len(young) >= self.most:
            self.young, self.old = {}, young
        return out


def strings(found: pa.Array) -> list[str]:
    """The same as to_pylist, in a fraction of its time."""
    return found.to_numpy(zero_copy_only=False).tolist()


def is_word(text: str) -> bool:
    """Letters alone, of scripts whose letters all versions of Unicode agree on."""
    return text.isalpha() and (text.isascii() or max(text) < _SETTLED)


class Cutter:
    """Cuts texts into pieces that no pre-token crosses the ends of."""

    def __init__(self, drops_white: bool, special: list[str]):
        self.drops_white, self.special = drops_white, special
        self.unsure = f"[{WHITE}]{{3}}|[{WHITE}]{{2}}\\z"

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """Pieces of all texts, the bounds of each text among them, and numbers of texts that are not cut (and have none)."""
        odd = pc.match_substring(texts, _MARK)
        if not self.drops_white:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.unsure))
            for x in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, x))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            texts = pc.if_else(odd, "", texts)
        if self.drops_white:
            parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", _MARK + " "), "\n", f"{_MARK}\n{_MARK}"), _MARK)
        bounds = parts.offsets.to_numpy()
        return parts.flatten().dictionary_encode(), bounds - bounds[0], whole


class PieceEncoder:
    """ids_of(texts): the library's ids as little-endian bytes of `dtype`; equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        #: White space is dropped by this tokenizer if it has no id of its own.
        self.drops_white = not self.library.encode(" \n ", add_special_tokens=False).ids
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.cutter = Cutter(self.drops_white, special)
        self.merges = self.library.model
        self.bytes = {b: c for b, c in enumerate(byte_characters())}
        self.forget()
        self._behind = np.zeros(256, np.int64)
        self._behind[[*_BEHIND.encode()]] = np.arange(len(_BEHIND))

    def forget(self) -> None:
        """Empties the stores, which hold some hundred MB when full, for as long as the worker lives."""
        self.words: Kept[bytes] = Kept()
        self.others: Kept[bytes] = Kept(KEPT // 4)
        self.tails: Kept[bytes] = Kept(KEPT // 4)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self._code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _symbols(self, piece: str) -> str | None:
        """The symbols that the library's merges start from, if the piece is one pre-token of letters; else None."""
        if self.drops_white:
            if not is_word(piece):
                return None
            if piece.isascii():
                return piece.lower()
            # the library lower-cases letter by letter, behind its composition
            normal = "".join(map(str.lower, unicodedata.normalize("NFC", piece)))
            return normal.encode().decode("latin-1").translate(self.bytes) if is_word(normal) else None
        word = piece[1:] if piece[:1] == " " else piece
        if not is_word(word):
            return None
        return ("Ġ" + word if len(word) < len(piece) else word) if word.isascii() else piece.encode().decode("latin-1").translate(self.bytes)

    def _word(self, symbols: str) -> bytes:
        return array(self._code, [t.id for t in self.merges.tokenize(symbols)]).tobytes()

    def _words(self, pieces: list[str]) -> Iterable[bytes | str]:
        """Ids of words; of other pieces the piece itself, as punctuation behind them may not be told apart."""
        for x in pieces:
            symbols = self._symbols(x)
            yield x if symbols is None else self._word(symbols)

    def _tails(self, found: pa.Array, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of what stands behind the first `length` bytes of each piece: distinct values, and which of them each piece has."""
        ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1]
        more = np.diff(ends) - length
        which = np.zeros(len(found), np.int64)
        one = np.flatnonzero(more == 1)
        data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
        which[one] = 1 + self._behind[data[ends[one + 1] - 1]]
        names, numbers = [], {}
        long = np.flatnonzero(more > 1)
        for n, x, k in zip(long.tolist(), found.take(pa.array(long)).cast(pa.binary()).to_pylist(), more[long].tolist(), strict=True):
            tail = x[-k:].decode()
            if (number := numbers.get(tail)) is None:
                number = numbers[tail] = len(numbers)
                names.append(tail)
            which[n] = 1 + len(_BEHIND) + number
        return [b"", *self.tails.all([*_BEHIND], self._library), *self.tails.all(names, self._library)], which

    def _pieces(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some distinct pieces one behind the other, and their numbers."""
        bare = pc.utf8_rtrim(found, _BEHIND).dictionary_encode()
        which = bare.indices.to_numpy().astype(np.int64)
        words = self.words.all(strings(bare.dictionary), self._words)
        tails, behind = self._tails(found, pc.binary_length(bare.dictionary).to_numpy()[which])
        unknown = [n for n, x in enumerate(words) if type(x) is str]
        if unknown:  # pieces with these are encoded whole
            whole = np.zeros(len(words), bool)
            whole[unknown] = True
            at = np.flatnonzero(whole[which])
            own = self.others.all(strings(found.take(pa.array(at))), self._library)
            which[at], behind[at] = len(words) + np.arange(len(at)), 0
            for n in unknown:
                words[n] = b""
            words += own
        table, size = self._table([*words, *tails])
        order = np.empty(2 * len(found), np.int64)
        order[::2], order[1::2] = which, len(words) + behind
        ids, ends = _gathered(table, size, order)
        return ids, np.diff(ends[::2])

    def _table(self, each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(each), self.dtype), np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize

    def ids_of(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        pieces, bounds, whole = self.cutter.cut(texts)
        ids, ends = _gathered(*self._pieces(pieces.dictionary), pieces.indices.to_numpy())
        data = ids.tobytes()
        at = (ends[bounds] * self.dtype.itemsize).tolist()
        out = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if len(whole):
            for k, own in zip(whole.tolist(), self._library(texts.take(pa.array(whole)).to_pylist()), strict=True):
                out[k] = own
        return out


def _gathered(table: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a table (sizes as given) in an order, one behind the other, and the bounds of each."""
    first = np.cumsum(size) - size
    n = size[order]
    ends = np.concatenate([[0], np.cumsum(n)])
    return table[np.arange(ends[-1]) + np.repeat(first[order] - ends[:-1], n)], ends


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    moved = {b: 0x100 + n for n, b in enumerate(others)}
    return [chr(moved.get(b, b)) for b in range(256)]


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One for each path and Python worker."""
    return PieceEncoder(path)
