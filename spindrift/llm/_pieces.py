"""A SentencePiece vocabulary as a unigram model, and texts as marked words.

The score of a segmentation is the sum of its pieces' scores in the model file; the best one wins,
and where two paths into a place are equal, the one with the longer last piece. A character that no
single-character piece covers is an unknown: it costs ten below the lowest score and is written as
its UTF-8 bytes.

A text is encoded as mark + text with each space as a mark (U+2581). In no piece does a mark follow
another character, and none holds a line feed, so the stretches that start at a run of spaces or
after a line feed are independent: they are encoded on their own, a line feed is its byte piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from spindrift.llm import _text as tx

U64, I64 = np.uint64, np.int64
MARK = "▁"
_UNMARKED = U64(0x5851F42D4C957F2D)


@dataclass
class Vocabulary:
    pieces: list[str]  # the ordinary ones
    scores: np.ndarray
    ids: np.ndarray
    bytes_: np.ndarray  # ids of the 256 byte pieces
    surface: list[bytes]  # by id, for decoding
    unknown: float = 0.0

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))


def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, ids, byte_ids = [], [], [], np.full(256, -1, I64)
    surface = [b""] * model.get_piece_size()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            surface[i] = piece.replace(MARK, " ").encode()
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"{path}: piece {i} spans words")
            pieces.append(piece)
            scores.append(model.get_score(i))
            ids.append(i)
    if (byte_ids < 0).any():
        raise ValueError(f"{path}: no byte pieces")
    return Vocabulary(pieces, np.array(scores), np.array(ids), byte_ids, surface, min(scores) - 10)


def segments(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number, marked) of each stretch; a mark that comes first isn't part of start..end."""
    full = np.flatnonzero(np.diff(off) > 0)
    space = raw == 0x20
    cut = space.copy()
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    cut[1:] &= ~space[:-1] | first[1:-1]  # the first of a run
    cut &= ~first[:-1]  # a text starts with a mark of its own
    cut = np.flatnonzero(cut | (raw == 0x0A))
    doc = np.concatenate([full, np.searchsorted(off, cut, "right") - 1])
    start = np.concatenate([off[full], cut + 1])
    marked = np.concatenate([np.ones(len(full), bool), raw[cut] == 0x20])
    order = np.lexsort((start, doc))
    start, doc, marked = start[order], doc[order], marked[order]
    end = off[doc + 1].copy()
    same = doc[1:] == doc[:-1]
    end[:-1][same] = start[1:][same] - 1
    return start, end, doc, marked


def segment_keys(raw: np.ndarray, start: np.ndarray, end: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """A hash of each segment and its mark; 1 for a mark alone, 0 for nothing."""
    key = marked.astype(U64)
    some = np.flatnonzero(end > start)
    if len(some):
        key[some] = tx.word_hashes(raw, start[some], end[some], lower=False) ^ np.where(marked[some], U64(0), _UNMARKED)
    return key
