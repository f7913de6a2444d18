"""Token ids of whole texts, word by word.

The tokenizer never joins characters across white space, so a text's ids are its words' ids in a row. Texts are cut into
words and numbered as Arrow arrays, some megabytes at once; only a chunk's distinct words become Python strings. Each
worker keeps the ids of short words it has met, in two generations, so that memory is bounded and frequent words stay.
Only new words reach the tokenizer library, without their case and punctuation where these do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gaugeworks.llm.common import give_back, text_bytes

#: Words in one of the two generations that a worker keeps, and the most characters of such a word.
KEPT_WORDS = 200_000
KEPT_LENGTH = 64
#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 21
_GAPS = b"\t\n\v\f\r "
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Kinds of bytes: gaps 0, letters 1, other ASCII 2, and 3 for what keeps its word whole.
_KINDS = bytes(0 if c in _GAPS else 3 if c > 127 or c in b"'<" else 1 if chr(c).isalpha() else 2 for c in range(256))
#: Byte-level models name the bytes that have no glyph, in order, from U+0100 on.
_BARE = [*range(33), *range(127, 161), 173]
_GLYPHS = np.arange(256, dtype="<u2")
_GLYPHS[_BARE] = np.arange(256, 256 + len(_BARE))
_GLYPHS[32] = 32  # between words
_SPACE = pa.scalar(" ", pa.large_string())
_LATIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_LATIN_LINE = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff ]+").fullmatch  # words have no spaces


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass
class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit bytes.

    `path` is a file that every worker can read, of a BPE tokenizer that lower-cases, splits letters from digits and
    punctuation and marks ends of words with </w>.
    """

    path: str
    known: dict[str, bytes] = field(default_factory=dict)
    before: dict[str, bytes] = field(default_factory=dict)
    tokenizer: object = None
    ends: object = None
    direct: bool = False
    tokenize: object = None
    bare: object = None

    def load(self) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(self.path)
        model = self.tokenizer.model  # asked for once: every look at it makes a new object
        self.tokenize, self.bare = model.tokenize, Tokenizer(model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Lower-case words of Latin letters pass normalising and splitting unchanged: the model alone gives their ids.
        probes = ["a", "the", "qxzvk", "abcdefghijklmnopqrstuvwxyz" * 3, "é", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "straßeñandú"]
        known = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probes]
        ids = self.ended(self.bare, probes, self.glyphs(probes))
        self.direct = known == list(map(self.of_model, probes)) and ids == [np.array(x, "<u4").tobytes() for x in known]

    def of_model(self, word: str) -> list[int]:
        """The ids of a lower-case word of Latin letters."""
        return [token.id for token in self.tokenize(self.glyphs([word]))]

    def glyphs(self, words: list[str]) -> str:
        """Lower-case words of Latin letters as the model sees them, with spaces between."""
        text = " ".join(words).lower()
        return text if text.isascii() else _GLYPHS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def ended(self, tokenizer, words: list[str], text: str) -> list[bytes] | None:
        """The ids of each of `words`, which are `text` together; None if they do not end where words do."""
        ids = np.array(getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] if len(cuts) == len(words) else None

    def whole(self, words: list[str]) -> list[bytes]:
        """Ids of words, from the library."""
        if self.tokenizer is None:
            self.load()
        found: list[bytes | None] = []
        for at in range(0, len(words), 2000):
            found += self.some_whole(words[at : at + 2000])
        return found

    def some_whole(self, words: list[str]) -> list[bytes]:
        # Mostly all words are of Latin letters, and one look tells.
        if self.direct and _LATIN_LINE(" ".join(words)) and (ids := self.ended(self.bare, words, self.glyphs(words))):
            return ids
        found: dict[str, bytes] = {}
        latin = [w for w in words if _LATIN(w)] if self.direct else []
        if latin and (ids := self.ended(self.bare, latin, self.glyphs(latin))):
            found.update(zip(latin, ids, strict=True))
        # Plain words end where a token does, so many of them go as one text.
        plain = [w for w in words if w not in found and w.isalpha()]
        if plain and (ids := self.ended(self.tokenizer, plain, " ".join(plain))):
            found.update(zip(plain, ids, strict=True))
        rest = [w for w in words if w not in found]
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for word, own in zip(rest, encode(rest, add_special_tokens=False) if rest else [], strict=True):
            found[word] = np.array(own.ids, "<u4").tobytes()
        return [found[w] for w in words]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; short ones are kept."""
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if not missing:
            return found
        asked = [words[i] for i in missing]
        ids = list(map(self.before.get, asked))
        made = iter(self.whole([w for w, x in zip(asked, ids, strict=True) if x is None]))
        ids = [next(made) if x is None else x for x in ids]
        if len(self.known) + len(asked) > KEPT_WORDS:
            # A new generation has all words of these texts.
            kept = {w: x for w, x in zip(words, found, strict=True) if x is not None}
            self.before, self.known = self.known, kept
        if max(map(len, asked)) <= KEPT_LENGTH:
            self.known.update(zip(asked, ids, strict=True))
        else:
            self.known.update({w: x for w, x in zip(asked, ids, strict=True) if len(w) <= KEPT_LENGTH})
        for i, x in zip(missing, ids, strict=True):
            found[i] = x
        return found

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids) of the texts between `bounds` of UTF-8 bytes.

        A-Z are lower-cased here, as the tokenizer does, but not in texts that may hold special tokens. Words of ASCII and
        letters up to U+00FF are cut where letters meet other characters, as the tokenizer cuts them too, so that few
        distinct ones are left; words with other bytes, apostrophes (contractions) or "<" (special tokens) stay whole.
        """
        raw = data.tobytes()
        low = raw.translate(_LOWER)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if b"<|" in raw else []
        if len(special):
            low = bytearray(low)
            for row in np.unique(np.searchsorted(bounds, special, "right") - 1).tolist():
                low[bounds[row] : bounds[row + 1]] = raw[bounds[row] : bounds[row + 1]]
            low = bytes(low)
        kind = np.frombuffer(raw.translate(_KINDS), np.uint8)
        if len(lead := np.flatnonzero(data == 0xC3)):  # U+00C0 to U+00FF, letters but for two
            kind = kind.copy()
            letter = (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)
            kind[lead[letter]] = kind[lead[letter] + 1] = 1
        inside = kind > 0
        edge = np.zeros(len(kind) + 1, bool)
        edge[bounds] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]  # texts follow each other without a gap
        starts = np.flatnonzero(opens)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        stops = np.flatnonzero(closes) + 1
        cuts = np.flatnonzero((kind[1:] != kind[:-1]) & inside[1:] & ~opens[1:]) + 1
        whole = np.zeros(len(starts), bool)
        whole[np.searchsorted(starts, np.flatnonzero(kind == 3), "right") - 1] = True
        cuts = cuts[~whole[np.searchsorted(starts, cuts, "right") - 1]]
        # A cut ends one word and starts another.
        starts, stops = (np.sort(np.concatenate((x, cuts)), kind="stable") for x in (starts, stops))
        offsets = np.concatenate(([0], np.cumsum(stops - starts)))
        del opens, closes, edge, stops
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low.translate(None, _GAPS))])
        numbered = words.dictionary_encode()
        # Joined and split as one string: words have no spaces, and one by one Arrow takes longer to hand them over.
        found = self.ids_of(pc.binary_join(pa.LargeListArray.from_arrays([0, len(numbered.dictionary)], numbered.dictionary), _SPACE)[0].as_py().split(" "))
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))), pa.array(np.frombuffer(b"".join(found), np.uint32)))
        of_words = lists.take(numbered.indices)
        ends = np.concatenate(([0], np.cumsum(lengths[numbered.indices.to_numpy()])))
        return of_words.flatten().to_numpy(), ends[np.searchsorted(starts, bounds)]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of each row's ids) of a string column, chunk by chunk; null texts have no ids."""
        data, offsets = text_bytes(column)
        first, rows = 0, len(offsets) - 1
        while first < rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            ids, own = self.encode_bytes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            yield first, ids, own
            first = last
        del data, offsets
        give_back()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; of a null text none."""
        for _, ids, own in self.encode_column(pa.array(texts, pa.large_string())):
            for a, b in zip(own[:-1], own[1:], strict=True):
                yield ids[a:b].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, which keeps its words from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
