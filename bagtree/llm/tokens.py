"""Token ids of whole texts by a public tokenizer, inside tasks."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bagtree.llm.words import chunks

# A control character stands between distinct words that are encoded in one call; a word that holds it goes alone.
_BETWEEN = "\x01"
# utf8_split_whitespace takes these for white space, tokenizers do not.
_NOT_SPACE = 0x1C, 0x1F
# Letters that no normal form joins with another of these or with a mark, and whose lower case is one letter; then ASCII marks.
# Such tokenizers part the letters from the run of marks.
_LETTERS_AND_MARKS = (
    r"^(?P<base>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}"
    r"\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
)
# The characters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {byte: 0x100 + n for n, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PIECE_BYTES = 16 << 20
_JOINED_WORDS = 200


class TextEncoder:
    """``encode(texts)``: all ids in one array, and the number of ids of each text.

    ``words_apart`` says that the tokenizer drops white space, lower-cases, and never joins what white space parts or letters with
    marks (``drops_white_space``), so that a text's ids are its words' ids one after another; then each distinct word is encoded once and
    looked up afterwards. At most ``max_words`` are remembered. ``literal_specials`` makes the strings of special tokens ordinary
    text. A null text has no ids.
    """

    def __init__(self, path: str, words_apart: bool, literal_specials: bool = False, max_words: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if literal_specials:
            self.tokenizer.encode_special_tokens = True
        self.words_apart, self.max_words = words_apart, max_words
        between = self._ids([_BETWEEN])[0]
        self.between = between[0] if len(between) == 1 else None
        # Word number i is known[i]; its ids are flat[starts[i] : starts[i + 1]], and it was asked for met[i] times.
        self.known, self.flat = pa.array([], pa.string()), np.empty(0, np.uint32)
        self.starts, self.met = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after another, and how many each has."""
        words = pa.ListArray.from_arrays(pa.array(self.starts.astype(np.int32)), pa.array(self.flat))
        return words.take(pa.array(numbers)).flatten().to_numpy(), self.starts[numbers + 1] - self.starts[numbers]

    def _keep_frequent(self) -> None:
        """Forget the words that were met once, and all if those are few; what was met often must be so again."""
        kept = np.flatnonzero(self.met > 1)
        if 2 * len(kept) > len(self.known):
            kept = kept[:0]
        flat, length = self._ids_of(kept)
        self.known, self.flat = self.known.take(pa.array(kept)), flat
        self.starts, self.met = np.concatenate([[0], np.cumsum(length)]), np.zeros(len(kept), np.int64)

    def _store(self, words: pa.Array, ids: np.ndarray, length: np.ndarray) -> None:
        """Remember the ids of the next words."""
        self.known, self.flat = pa.concat_arrays([self.known, words]), np.concatenate([self.flat, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(length)])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 where it is not known."""
        return pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Take in distinct words and return their numbers: words of letters by the model, letters and marks, or capitals, from the ids of
        their parts, all others by the tokenizer."""
        found = pc.extract_regex(new, _LETTERS_AND_MARKS)
        base, marks = pc.utf8_lower(pc.struct_field(found, "base")), pc.struct_field(found, "marks")
        same = pc.equal(base, new)  # null for words of other kinds
        letters, parted = np.flatnonzero(_true(same)), np.flatnonzero(_true(pc.invert(same)))
        others = np.flatnonzero(_true(pc.is_null(same)))
        parts = pa.concat_arrays([base.take(pa.array(parted)), marks.take(pa.array(parted))]).dictionary_encode()
        first = len(self.known)
        for words, encode in ((new.take(pa.array(letters)), self._encode_letters), (new.take(pa.array(others)), self._encode_words)):
            self._store(words, *encode(words))
        number = self._numbers(parts.dictionary)
        missing = parts.dictionary.filter(pa.array(number < 0))
        is_base = pc.utf8_is_alpha(missing)  # else a run of marks, or none
        begin = len(self.known)
        more_letters, more_marks = missing.filter(is_base), missing.filter(pc.invert(is_base))
        self._store(more_letters, *self._encode_letters(more_letters))
        self._store(more_marks, *self._encode_words(more_marks))
        of_missing = np.empty(len(missing), np.int64)
        of_missing[np.argsort(~_true(is_base), kind="stable")] = np.arange(begin, len(self.known))
        number[number < 0] = of_missing
        pairs = number[parts.indices.to_numpy()].reshape(2, -1).T.ravel()
        ids, length = self._ids_of(pairs)
        self._store(new.take(pa.array(parted)), ids, length.reshape(-1, 2).sum(axis=1))
        out = np.empty(len(new), np.int64)
        out[letters] = first + np.arange(len(letters))
        out[others] = first + len(letters) + np.arange(len(others))
        out[parted] = len(self.known) - len(parted) + np.arange(len(parted))
        return out

    def _encode_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-case words of letters, which are one piece each, one after another and how many each has."""
        model = self.tokenizer.model
        ids, length = array("I"), np.empty(len(words), np.int64)
        for n, word in enumerate(words.to_numpy(zero_copy_only=False)):
            tokens = model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS))
            ids.extend([t.id for t in tokens])
            length[n] = len(tokens)
        return np.array(ids, np.uint32), length

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another and how many each has, all words in few calls."""
        odd = pc.match_substring(words, _BETWEEN)
        if self.between is None or pc.any(odd).as_py():
            return _flat(self._ids(words.to_pylist()))
        bounds = np.append(np.arange(0, len(words), _JOINED_WORDS), len(words)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words), f" {_BETWEEN} ").to_pylist()
        ids = _flat([[*x, self.between] for x in self._ids(joined)])[0]
        end = ids == self.between
        return ids[~end], np.diff(np.flatnonzero(end), prepend=-1) - 1

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """In pieces, so that what is needed at a time stays small."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(size) - size) // _PIECE_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
        parts = [self._encode(texts.slice(a, b - a)) for a, b in zip(bounds, bounds[1:])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        if not self.words_apart or _holds(texts, *_NOT_SPACE):
            texts = texts.to_pylist()
            parts = [_flat(self._ids(texts[p])) for p in chunks(texts)]
            return _flat([p[0] for p in parts])[0], np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])
        if len(self.known) > self.max_words:
            self._keep_frequent()
        lists = pc.utf8_split_whitespace(texts)  # an empty word before, between or after white space has no ids
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary
        number = self._numbers(distinct)
        new = number < 0
        if new.any():
            number[new] = self._learn(distinct.filter(pa.array(new)))
        number = number[words.indices.to_numpy()]
        self.met += np.bincount(number, minlength=len(self.known))
        ids, length = self._ids_of(number)
        ends = np.concatenate([[0], np.cumsum(length)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after another, and their lengths."""
    arrays = [np.array(x, np.uint32) for x in lists]
    return np.concatenate([np.empty(0, np.uint32), *arrays]), np.fromiter(map(len, arrays), np.int64, len(arrays))


def _true(mask: pa.Array) -> np.ndarray:
    return mask.fill_null(False).to_numpy(zero_copy_only=False)


def _holds(texts: pa.Array, least: int, most: int) -> bool:
    """Whether a byte from ``least`` to ``most`` lies in the texts."""
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return False
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    begin, end = int(offsets[texts.offset]), int(offsets[texts.offset + len(texts)])
    held = np.frombuffer(data, np.uint8, end - begin, begin)
    return bool(((held >= least) & (held <= most)).any())


_encoders: dict[tuple, TextEncoder] = {}


def encoder(path: str, words_apart: bool, literal_specials: bool = False) -> TextEncoder:
    """The worker process keeps its encoder, and the words it knows, from task to task."""
    key = (path, words_apart, literal_specials)
    if key not in _encoders:
        _encoders[key] = TextEncoder(*key)
    return _encoders[key]


def drops_white_space(path: str) -> bool:
    """Whether a tokenizer file's pieces never hold or cross white space or cross from letters to marks, are lower-cased, and
    go to a byte-level pair encoding: it keeps only matches of a pattern that says so."""
    import json

    with open(path) as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = steps[0] if steps else {}
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in steps[1:]] == ["ByteLevel"]
        and not steps[1]["add_prefix_space"]
        and spec["model"]["type"] == "BPE"
        and not spec["model"]["dropout"]
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "")
    )
