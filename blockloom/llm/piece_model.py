"""A subword model's normalisation and merges, with the source bytes of every piece."""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np

MARK = "▁"
CACHED_BYTES = 120 << 20  # of segments and their ids that a worker keeps, with what Python adds
ENTRY_BYTES = 230
CACHED_LENGTH = 40
SLICE_CHARS = 1 << 18  # of a text whose segments are listed at once
NEVER = float("-inf")
HEAP_FROM = 40  # symbols; shorter stretches are merged by plain search


class CharacterMap:
    """The compiled map of a model: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.targets = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped string that starts at ``at``."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for stop in range(at, len(source)):
            node ^= source[stop]
            if node >= len(self.units) or self.units[node] & 0x800000FF != source[stop]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = stop + 1 - at, self.targets[start : self.targets.index(0, start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class PieceModel:
    """Encoder of one model file; ids and source spans of whole texts.

    The model must merge pairs by score, fall back to bytes and have no user-defined or
    unused pieces; others are refused. A stretch of text up to a space mark is encoded once
    and kept while there is room, counted in bytes: no piece has a mark after another character, so no merge
    crosses such a place. The same holds at some punctuation.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trainer, kinds = model.normalizer_spec, model.trainer_spec, proto.ModelProto.SentencePiece
        if trainer.model_type != proto.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only pair-merging models with byte fallback and leading space marks are read")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece crosses a space mark")
        self.bytes = np.zeros(256, "<u4")
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.begin, self.end = ([i for i, p in enumerate(model.pieces) if p.piece == name][0] for name in ("<s>", "</s>"))
        # Bytes of a piece's normalised form, with a mark as one byte, and as it is.
        self.plain_bytes = np.ones(len(model.pieces), np.int64)
        self.mapped_bytes = np.ones(len(model.pieces), np.int64)
        for piece, i in self.ids.items():
            self.mapped_bytes[i] = len(piece.encode())
            self.plain_bytes[i] = self.mapped_bytes[i] - 2 * piece.count(MARK)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.segments = self._segments()
        self.cuts = re.compile(f"(?<=[^{MARK}]){MARK}")

    def _segments(self) -> re.Pattern:
        """Stretches that no merge leaves: up to a space mark, and up to a mark of punctuation
        after a letter or digit if no piece has such two characters in a row."""
        joined = {piece[i + 1] for piece in self.ids for i in range(len(piece) - 1) if piece[i].isalnum()}
        apart = re.escape("".join(c for c in ".,;:!?" if c not in joined))
        if not apart:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        return re.compile(f"{MARK}*[^{MARK}](?:[^{MARK}{apart}]+|(?<![^\\W_])[{apart}])*|{MARK}+")

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes the source byte where it comes from.

        The longest mapped prefix is replaced, anything else is taken over one character at
        a time. One more entry than bytes: the last is the end of what was read.
        """
        source, out, origin = text.encode(), bytearray(), []
        space = MARK.encode() if self.escape else b" "
        if not source:
            return "", np.zeros(1, np.int64)
        if self.prefix:
            out += space
        at, before_space, started = 0, self.squeeze, False
        while at < len(source):
            width, target = self.map.longest(source, at) or _one(source, at)
            if before_space:
                target = target.lstrip(b" ")
            if target and not started:
                origin, started = [at] * len(out), True
            if target:
                chars = target.replace(b" ", space)
                out += chars
                origin += [at] * len(chars)
                before_space = self.squeeze and target.endswith(b" ")
            at += width
        end = len(source)
        if self.squeeze:
            while out.endswith(space) and len(origin) >= len(space) and started:
                end = origin[-len(space)]
                del out[-len(space) :], origin[-len(space) :]
        if not started:
            return "", np.zeros(1, np.int64)
        return out.decode(), np.array([*origin, end], np.int64)

    def encode(self, text: str | None) -> tuple[bytes, bytes, bytes]:
        """Ids, and first and past-the-last source byte of each, as little-endian 32-bit integers.

        Begin and end ids stand at the ends, with empty spans. Pieces of a character's bytes
        span one byte each when the text is taken over as it is, else the whole source of it.
        """
        text = text or ""
        if self.held > CACHED_BYTES:
            self.known, self.held = {}, 0
        if self.map.units or self.squeeze or not self.escape or MARK in text:
            ids, starts, ends = self._mapped(text)
        else:
            marked = (MARK if self.prefix and text else "") + text.replace(" ", MARK)
            ids = np.frombuffer(self._ids(marked), "<u4")
            sizes = self.plain_bytes[ids]
            if self.prefix and len(sizes):
                sizes[0] -= 1
            ends = np.cumsum(sizes)
            starts = ends - sizes
        last = ends[-1:] if len(ends) else np.zeros(1, np.int64)
        ids = np.concatenate(([self.begin], ids, [self.end]))
        starts, ends = np.concatenate(([0], starts, last)), np.concatenate(([0], ends, last))
        return tuple(values.astype("<u4").tobytes() for values in (ids, starts, ends))

    def _mapped(self, text: str):
        marked, origin = self.normalised(text)
        ids = np.frombuffer(self._ids(marked), "<u4")
        stops = np.cumsum(self.mapped_bytes[ids])
        return ids, origin[stops - self.mapped_bytes[ids]], origin[stops]

    def _ids(self, marked: str) -> bytes:
        """Ids of a normalised text; a long one is cut before space marks that follow another
        character, where a segment ends in any case."""
        out, at = [], 0
        while at < len(marked):
            cut = self.cuts.search(marked, at + SLICE_CHARS)
            stop = cut.start() if cut else len(marked)
            out.append(self._slice_ids(marked[at:stop]))
            at = stop
        return b"".join(out)

    def _slice_ids(self, marked: str) -> bytes:
        segments = self.segments.findall(marked)
        known, long = self.known, {}
        for segment in set(segments).difference(known):
            ids = self._merged(segment)
            known[segment] = ids = struct.pack(f"<{len(ids)}I", *ids)
            if len(segment) > CACHED_LENGTH:
                long[segment] = ids
            else:
                self.held += ENTRY_BYTES + len(ids)
        joined = b"".join(map(known.__getitem__, segments))
        for segment in long:
            del known[segment]
        return joined

    def _merged(self, segment: str) -> list[int]:
        parts = list(segment)
        parts = self._merge_long(parts) if len(parts) >= HEAP_FROM else self._merge_short(parts)
        out: list[int] = []
        for part in parts:
            number = self.ids.get(part)
            out += [number] if number is not None else self.bytes[np.frombuffer(part.encode(), np.uint8)].tolist()
        return out

    def _merge_short(self, parts: list[str]) -> list[str]:
        best_of = self.scores.get
        scores = [best_of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = best_of(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = best_of(parts[at] + parts[at + 1], NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] >= 0:
                pair = parts[left] + parts[after[left]]
                if pair in self.scores:
                    heapq.heappush(heap, (-self.scores[pair], left, after[left], pair))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            if after[left] != right or not parts[left] or parts[left] + parts[right] != pair:
                continue
            parts[left], parts[right] = pair, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            after[right] = -1
            offer(before[left])
            offer(left)
        return [part for part in parts if part]


def _one(source: bytes, at: int) -> tuple[int, bytes]:
    first = source[at]
    width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    return width, source[at : at + width]
