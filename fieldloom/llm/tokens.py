"""Token ids of whole texts from a byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from .batches import once_per_worker

#: Distinct pre-tokens whose ids a worker remembers before it starts anew.
REMEMBERED = 700_000
LONGEST_REMEMBERED = 64
#: New pre-tokens given to the library as one text.
CHAINED = 64
#: Characters split into pre-tokens in one go; longer texts are cut between two of them.
CHARACTERS = 1 << 20

# The split rule of byte-level BPE, for texts of the characters in PLAIN only. Words come
# first, as most parts are words and no other alternative can start like one.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
BLANKS = " \t\n\r"
SPLIT = re.compile(
    f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{BLANKS}{LETTERS}0-9]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
PLAIN = "\t\n\r -~¡§«°·»¿À-ÖØ-öø-ɏ–—‘-„…€"
OTHER = re.compile(f"[^{PLAIN}]")


#: The class of every character up to the last one in PLAIN: blank, letter, digit or other.
BLANK, LETTER, DIGIT, REST = range(4)
CLASSES = np.full(0x20AD, REST, np.uint8)
CLASSES[[ord(c) for c in map(chr, range(len(CLASSES))) if re.match(f"[{LETTERS}]", c)]] = LETTER
CLASSES[[ord(c) for c in "0123456789"]] = DIGIT
CLASSES[[ord(c) for c in BLANKS]] = BLANK


def starts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pre-tokens of SPLIT begin in a text of PLAIN characters, in characters; and the characters' codes."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kinds = CLASSES[codes]
    new = np.ones(len(codes), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    # The last of some blanks leaves them where anything follows; a space goes on into what follows.
    last = np.flatnonzero((kinds[:-1] == BLANK) & (kinds[1:] != BLANK))
    new[last] = True
    new[last[codes[last] == 32] + 1] = False
    # A contraction is the quote and a letter or two, where the quote begins a pre-token and letters follow.
    quote = np.flatnonzero(codes[:-1] == 39)
    quote = quote[new[quote] & (kinds[quote + 1] == LETTER)]
    if len(quote):
        padded = np.append(codes, [0, 0])
        first, second = padded[quote + 1], padded[quote + 2]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = np.logical_or.reduce([(first == ord(a)) & (second == ord(b)) for a, b in ("re", "ve", "ll")])
        new[quote[one | two] + 1] = False
        ends = np.concatenate([quote[one] + 2, quote[two] + 3])
        new[ends[ends < len(codes)]] = True
    return np.flatnonzero(new), codes


def cut(text: str, most: int) -> list[str]:
    """A text in parts of about ``most`` characters, cut before single spaces between words, where pre-tokens begin."""
    out, start = [], 0
    while len(text) - start > most:
        at = start + most
        while (at := text.find(" ", at, len(text) - 1)) >= 0 and (text[at - 1] in BLANKS or text[at + 1] in BLANKS):
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


class Encoder:
    """Encodes texts to little-endian 32-bit ids.

    A text's ids are those of its pre-tokens one after another, so the library encodes each
    distinct pre-token once and later texts reuse its ids.  A text with characters outside
    ``PLAIN``, or one that holds a special token, goes to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of every text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        size = 0
        for nth, text in enumerate(texts):
            if OTHER.search(text) or any(s in text for s in self.special):
                out[nth] = self._ids([text])
                continue
            for part in cut(text, CHARACTERS) if text else ():
                held.append((nth, part))
                size += len(part)
                if size >= CHARACTERS:
                    self._encode(held, out)
                    held, size = [], 0
        if held:
            self._encode(held, out)
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def _encode(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Append the ids of parts of texts to their texts' lists.

        The pre-tokens of all parts are slices of one buffer, told apart without making each an object.
        """
        found = [starts_of(part) for _, part in parts]
        codes = np.concatenate([c for _, c in found])
        sizes = [len(c) for _, c in found]
        before = np.cumsum([0, *sizes])
        starts = np.concatenate([at + first for (at, _), first in zip(found, before)])
        octets = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF), dtype=np.int32)]).astype(np.int32)
        offsets = octets[np.append(starts, before[-1])]
        raw = "".join(part for _, part in parts).encode()
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        ids = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = words.indices.to_numpy()
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(counts) - counts
        flat = np.frombuffer(b"".join(ids), "<u4")
        mine = counts[which]
        ends = np.cumsum(mine)
        encoded = flat[np.repeat(first[which] - (ends - mine), mine) + np.arange(ends[-1])].tobytes()
        at = 0
        for (nth, _), last in zip(parts, np.cumsum([len(s) for s, _ in found])):
            stop = 4 * int(ends[last - 1])
            out[nth].append(encoded[at:stop])
            at = stop

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens."""
        known = self.known
        ids = list(map(known.get, parts))
        new = [part for part, got in zip(parts, ids) if got is None]
        if new:
            found = self._learned(new)
            ids = [found[part] if got is None else got for part, got in zip(parts, ids)]
            if len(known) + len(new) > REMEMBERED:  # start anew with what is in use, common ones among it
                known.clear()
                found = dict(zip(parts, ids))
            if max(map(len, found)) > LONGEST_REMEMBERED:
                found = {part: got for part, got in found.items() if len(part) <= LONGEST_REMEMBERED}
            known.update(found)
        return ids

    def _learned(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens.  Those that begin with a blank and go on with anything else stay apart
        when written one after another, so the library takes many of them as one text."""
        spaced = [p for p in parts if len(p) > 1 and p[0] == " " and p[1] not in BLANKS]
        found = {}
        groups = [spaced[at : at + CHAINED] for at in range(0, len(spaced), CHAINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False)):
            raw = np.array(e.ids, "<u4").tobytes()
            cuts = (np.flatnonzero(np.diff(np.array(e.word_ids, np.int64))) + 1) * 4
            bounds = [0, *cuts.tolist(), len(raw)]
            if len(bounds) == len(group) + 1:
                found.update(zip(group, map(raw.__getitem__, map(slice, bounds, bounds[1:]))))
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, self._ids(rest)))
        return found

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]


def encoder(path: str) -> Encoder:
    return once_per_worker(("encoder", path), lambda: Encoder(path))
