"""JSON texts that built-in functions don't read or write: with something after them, and with sorted keys."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object of a text, code fences and what follows dropped; null without one."""

    def one(text: str | None) -> str | None:
        start = (text or "").find("{")
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text[start:])[0], ensure_ascii=False) if start >= 0 else None
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """A JSON text with sorted keys and no spaces; null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)


def _loaded(text: str | None):
    """The value of a JSON text; None for null and for what isn't JSON."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def _paths(value, names: frozenset[str], root: str) -> Iterator[str]:
    """Paths of the keys of names at any depth, in the order in which they stand; what is below one isn't looked at."""
    todo = [(root, value, False)]
    while todo:
        at, x, found = todo.pop()
        if found:
            yield at
        elif isinstance(x, dict):
            todo += [(f"{at}.{k}", child, k in names) for k, child in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(f"{at}.{i}", child, False) for i, child in reversed(list(enumerate(x)))]


def key_paths(names: list[str], root: str = "workspace") -> Callable[[Column], Column]:
    """A function of a column of JSON texts: the paths, with points, of keys of names at any depth; none for null and for what isn't JSON."""
    wanted = frozenset(names)

    @F.pandas_udf(ArrayType(StringType()))
    def paths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(_paths(_loaded(t), wanted, root)))

    return paths


@F.pandas_udf(StringType())
def without_empty(texts: pd.Series) -> pd.Series:
    """A JSON text with null for each empty text, at any depth; null for what isn't JSON."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else None if x == "" else x

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(clean(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def with_fields(fields: dict, defaults: dict | None = None) -> Callable[[Column], Column]:
    """A function of a column of JSON objects: with fields, in the place of those of the same name or behind the others, and with the defaults that they lack; null for what is no object."""

    @F.pandas_udf(StringType())
    def changed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            found = _loaded(text)
            return json.dumps((defaults or {}) | found | fields, ensure_ascii=False, separators=(",", ":")) if isinstance(found, dict) else None

        return texts.map(one)

    return changed


def _plain(value) -> str:
    """JSON with sorted keys (by UTF-16 units) and no spaces; whole numbers without a fraction, as browsers write them."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_plain(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_plain, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def fnv1a(texts: list[str]) -> list[str]:
    """32-bit FNV-1a over the UTF-16 units of each text, as 8 hexadecimal digits; all texts take one unit at a time together."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    order = np.argsort([-len(u) for u in units], kind="stable")
    sizes = np.array([len(units[i]) for i in order])
    flat = np.concatenate([units[i] for i in order]) if len(units) else np.zeros(0, "<u2")
    first = np.cumsum(sizes) - sizes
    h = np.full(len(units), 0x811C9DC5, np.uint64)
    for k in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -k, "left"))  # texts longer than k
        h[:live] = ((h[:live] ^ flat[first[:live] + k].astype(np.uint64)) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
    out = [""] * len(units)
    for i, x in zip(order, h.tolist(), strict=True):
        out[i] = f"{x:08x}"
    return out


#: Texts that a worker holds as Python objects at a time.
SLICE = 1000


def _digests(values: list) -> list[str | None]:
    """FNV-1a of the canonical form of dicts without their field integrity; None for all else."""
    there = [i for i, x in enumerate(values) if isinstance(x, dict)]
    out: list[str | None] = [None] * len(values)
    for i, d in zip(there, fnv1a([_plain({k: v for k, v in values[i].items() if k != "integrity"}) for i in there]), strict=True):
        out[i] = d
    return out


def sealed(algorithm: str, fields: dict, defaults: dict | None = None) -> Callable[[Column, Column, Column], Column]:
    """A function of columns of JSON objects (head, workspace, more): the head with the workspace and its integrity, the digest of both, behind its fields; null for what is no object.

    The workspace gets fields and more's in the place of those of the same name or behind the others, and the defaults that it lacks. All in one pass: each pass has a worker for each core.
    """

    @F.pandas_udf(StringType())
    def packed(heads: pd.Series, spaces: pd.Series, more: pd.Series) -> pd.Series:
        def body(head: str | None, space: str | None, extra: str | None) -> dict | None:
            first, found = _loaded(head), _loaded(space)
            return first | {"workspace": (defaults or {}) | found | fields | (_loaded(extra) or {})} if isinstance(first, dict) and isinstance(found, dict) else None

        def some(k: int) -> list[str | None]:
            bodies = [body(*x) for x in zip(heads[k : k + SLICE], spaces[k : k + SLICE], more[k : k + SLICE], strict=True)]
            seals = [{"integrity": {"algorithm": algorithm, "digest": d}} for d in _digests(bodies)]
            return [None if x is None else json.dumps(x | seal, ensure_ascii=False, separators=(",", ":")) for x, seal in zip(bodies, seals, strict=True)]

        return pd.Series([x for k in range(0, len(heads), SLICE) for x in some(k)], dtype=object)

    return packed


def looked_into(names: list[str], root: str = "") -> Callable[[Column], Column]:
    """A function of a column of JSON texts: digest (FNV-1a of the canonical form of an object without its field integrity; null for what is no object) and the key_paths() of names."""
    wanted = frozenset(names)

    @F.pandas_udf("digest string, paths array<string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        digests, paths = [], []
        for k in range(0, len(texts), SLICE):
            values = [_loaded(t) for t in texts[k : k + SLICE]]
            digests += _digests(values)
            paths += [list(_paths(v, wanted, root)) for v in values]
        return pd.DataFrame({"digest": pd.Series(digests, dtype=object), "paths": pd.Series(paths, dtype=object)})

    return found


@F.pandas_udf(StringType())
def fnv1a_texts(texts: pd.Series) -> pd.Series:
    """FNV-1a of texts; null for null."""
    there = texts.notna()
    out = pd.Series([None] * len(texts), dtype=object)
    out[there.to_numpy()] = fnv1a(texts[there].tolist())
    return out
