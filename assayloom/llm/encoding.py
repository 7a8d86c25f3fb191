"""Token ids of whole texts with the tokenizers library, one encoding per distinct word of a batch."""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import objects

#: Words of these letters, with or without a tail of marks, take the short way where the tokenizer allows it.
PLAIN = "^(?P<head>[a-zß-öø-ÿ]+)(?P<tail>[.,;:!?#$%&*|]*)$"
#: Most words whose ids an encoder keeps from one batch for the next ones, and their most letters: 17 MB on check_l, some 60 MB at most.
KEPT_WORDS, KEPT_LETTERS = 1 << 17, 32
PROBES = ["a", "the", "reading", "thtionble", "lymphocyte", "ñandú", "straße", "ïœ"[:1] + "f", "éèêçàùü"]


class Encoder:
    """Ids of texts for a tokenizer whose pre-tokenizer drops white space and never joins across it.

    A text's ids are then those of its words in turn, so each distinct word of a batch is encoded
    once. Words that are plain once A-Z are lower-cased go so to the library's model and their closing
    marks are encoded apart; both only after probes show that this tokenizer gives the same ids for
    the whole. All other words go to the library as they are written: added tokens are matched by
    case, and marks are composed before letters are lower-cased. The ids of at most KEPT_WORDS plain
    words of at most KEPT_LETTERS are kept for later batches, the first ones met.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.kept: dict[str, bytes] = {}
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.model = t.model
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE shows these bytes as themselves
        self.shown = {b: b for b in keep} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in keep)}
        whole = lambda s: t.encode(s, add_special_tokens=False).ids
        self.folds = all(whole(w.upper()) == whole(w) for w in ("ABC", "Thet"))
        self.parts = all(whole("ab x,y.. é!") == whole("ab") + whole("x,y..") + whole("é!") for _ in (0,))
        self.short = self.folds and all(whole(w) == self._model(w) and whole(w + m) == whole(w) + whole(m) for w in PROBES for m in (",", ".", "!!", "%%%", "|"))
        if not self.parts:
            raise ValueError("this tokenizer's ids of a text are not those of its words")

    def _model(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.encode().decode("latin1").translate(self.shown))]

    def _plain(self, words: list[str]) -> list[bytes]:
        """The ids of plain words as 32-bit numbers; the model is asked for those that are not kept."""
        kept, out = self.kept, []
        for word in words:
            ids = kept.get(word)
            if ids is None:
                ids = array("i", self._model(word)).tobytes()
                if len(kept) < KEPT_WORDS and len(word) <= KEPT_LETTERS:
                    kept[word] = ids
            out.append(ids)
        return out

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [array("i", x.ids).tobytes() for x in self.tokenizer.encode_batch(strings, add_special_tokens=False)]

    def words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces, index): the ids of word i are those of pieces index[2 * i] and index[2 * i + 1]."""
        n = len(words)
        if not self.short:
            return _lists([b"", *self._encode(objects(words))]), np.stack([np.arange(1, n + 1), np.zeros(n, np.int64)], 1).reshape(-1)
        found = pc.extract_regex(pc.ascii_lower(words), PLAIN)
        plain = found.is_valid()
        rest = words.filter(pc.invert(plain))
        heads, tails = (found.field(k).filter(plain).dictionary_encode() for k in (0, 1))
        ids = [b"", *self._plain(objects(heads.dictionary))]
        at_tails = len(ids)
        ids += self._encode(objects(tails.dictionary))
        at_rest = len(ids)
        ids += self._encode(objects(rest))
        index = np.zeros((n, 2), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        index[plain, 0] = 1 + heads.indices.to_numpy()
        index[plain, 1] = at_tails + tails.indices.to_numpy()
        index[~plain, 0] = at_rest + np.arange(len(rest))
        return _lists(ids), index.reshape(-1)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of whole texts; null and empty texts have none."""
        texts = texts.cast(pa.string()).fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
        pieces, index = self.words(coded.dictionary)
        by_word = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy()[index].reshape(-1, 2).sum(1))]).astype(np.int32)),
            pieces.take(pa.array(index)).flatten(),
        )
        of = coded.indices
        counts = pc.list_value_length(by_word).to_numpy()[of.to_numpy(zero_copy_only=False)]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return by_word.take(of).flatten().to_numpy(), ends[offsets - offsets[0]]


def _lists(pieces: list[bytes]) -> pa.ListArray:
    """The 32-bit numbers of each piece."""
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(pieces), np.int32)))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)
