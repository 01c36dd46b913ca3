"""Models as bytes in a plain format: what they say, as JSON, and the numbers of their arrays behind it.  Reading them runs nothing."""

from __future__ import annotations

import json
from typing import Any

import numpy as np

#: Kinds of numbers that arrays may hold: booleans, integers and floating-point numbers.
KINDS = "biuf"


def pack(model: Any) -> bytes:
    """A number, a text, None, an array of numbers, or a tuple or list of such things, as deep as one likes."""
    arrays: list[bytes] = []

    def told(x: Any) -> Any:
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        if isinstance(x, np.generic):
            return x.item()
        if isinstance(x, np.ndarray) and x.dtype.kind in KINDS:
            arrays.append(np.ascontiguousarray(x).tobytes())
            return {"array": x.dtype.str, "shape": list(x.shape)}
        if isinstance(x, (tuple, list)):
            return [told(y) for y in x]
        raise TypeError(f"a model can't hold {type(x).__name__}")

    head = json.dumps(told(model)).encode()
    return b"".join([len(head).to_bytes(8, "little"), head, *arrays])


def unpack(data: bytes) -> Any:
    """What ``pack`` was given, lists as tuples; ValueError where the bytes are no model."""
    size = int.from_bytes(data[:8], "little")
    at = 8 + size

    def made(x: Any) -> Any:
        nonlocal at
        if isinstance(x, list):
            return tuple(made(y) for y in x)
        if not isinstance(x, dict):
            return x
        kind, shape = np.dtype(x["array"]), tuple(x["shape"])
        if kind.kind not in KINDS or any(not isinstance(n, int) or n < 0 for n in shape):
            raise ValueError("an array of another kind")
        n = int(np.prod(shape, dtype=object)) if shape else 1
        if at + n * kind.itemsize > len(data):
            raise ValueError("the model is cut off")
        out = np.frombuffer(data, kind, n, at).reshape(shape)
        at += n * kind.itemsize
        return out

    try:
        return made(json.loads(data[8 : 8 + size]))
    except (KeyError, TypeError, UnicodeDecodeError) as e:
        raise ValueError(f"no model: {e}") from e
