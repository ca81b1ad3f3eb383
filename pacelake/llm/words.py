"""Words of many texts at once: Arrow splits and numbers them, so each distinct word of a slice is handled once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """distinct: the words of a slice, each once (and perhaps an empty one that no text has). code: its number, for each word in order. bounds: for each text, where its words start; one more at the end."""

    distinct: pa.Array
    code: np.ndarray
    bounds: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """Words between runs of space and U+0009 to U+000D; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    bounds = bounds - bounds[0]
    encoded = flat.dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # white space at the ends of a text makes empty words
    empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
    if empty < 0:
        return Words(encoded.dictionary, code, bounds)
    full = code != empty
    return Words(encoded.dictionary, code[full], np.r_[0, np.cumsum(full)][bounds])
