"""Token ids of whole columns by a word-level vocabulary file of the tokenizers library.

Tokens of this kind of vocabulary never cross white space, so a batch of texts is cut at ASCII white
space in Arrow, each distinct word of the batch is looked up once, and ids are gathered by index.
Words of plain letters, digits and marks go to the file's own merge model piece by piece; any other
word goes through the library's full encoder. A file that normalizes or cuts otherwise than this module
knows is noticed when it is loaded: its texts go whole through the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The cut of the vocabulary file's pre-tokenizer, after lower-casing; the settings that the cut at words relies on.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = regex.compile(CUT)
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
#: Words for which NFC changes nothing and lower-casing goes letter by letter.
PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ſ]*")
#: Marks that end a word as a piece of their own.
MARKS = frozenset(".,;:!?")
#: Entries that a worker process keeps at most in either of its caches.
KEPT = 250_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


def _cuts_at_words(file: dict) -> bool:
    """Whether a vocabulary file has the settings that encoding word by word relies on."""
    added = [t["content"] for t in file.get("added_tokens") or []]
    model = file["model"]
    plain = not model.get("dropout") and not model.get("fuse_unk") and model.get("unk_token") is None
    return (
        file.get("normalizer") == NORMALIZER and file.get("pre_tokenizer") == PRE_TOKENIZER and model.get("type") == "BPE" and plain
        and not file.get("truncation") and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)
    )


class WordEncoder:
    """encode(texts) for Arrow string columns; one instance for each process and file."""

    _made: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = byte_letters()
        #: The bytes of each id.
        self.coded = {i: i.to_bytes(self.dtype.itemsize, "little") for i in self.whole.get_vocab().values()}
        with open(path, encoding="utf-8") as f:
            self.by_words = _cuts_at_words(json.load(f))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelt = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            found = b"".join([self.coded[t.id] for t in self.model.tokenize(spelt)])
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if len(word) < 1000 and (word.isascii() or PLAIN.fullmatch(word)) and (word.isalpha() or (word[-1:] in MARKS and word[:-1].isalpha())):
            # Letters are one piece, and a mark after them is another.
            ids = self._piece(word.lower()) if word.isalpha() else self._piece(word[:-1].lower()) + self._piece(word[-1])
        elif PLAIN.fullmatch(word) and "<|" not in word and len(word) < 1000:
            ids = b"".join([self._piece(p) for p in PIECES.findall(word.lower())])
        else:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.words) >= KEPT:
            self.words.clear()
        self.words[word] = ids
        return ids

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]], with ``end`` as its last id if given. Null is an empty text."""
        if not self.by_words:
            found = [np.array(self.whole.encode(t or "", add_special_tokens=False).ids + [end] * (end is not None), self.dtype) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.dtype), *found]), np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        known, distinct = self.words, coded.dictionary.to_pylist()
        spelt = [found if (found := known.get(w)) is not None else self._word(w) for w in distinct]
        index = np.asarray(coded.indices)
        size = np.fromiter(map(len, spelt), np.int64, len(spelt)) // self.dtype.itemsize
        at = np.concatenate([[0], np.cumsum(size[index])])
        data = pa.array(spelt, pa.large_binary()).take(coded.indices)
        blob = data.buffers()[2]
        ids = np.frombuffer(blob, self.dtype, int(at[-1])) if blob is not None else np.zeros(0, self.dtype)
        bounds = at[offsets]
        if end is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.array(end, self.dtype)), bounds + np.arange(len(bounds))
