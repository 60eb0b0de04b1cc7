"""The best entries of many lookups by cosine, as matrices: a task holds a part of a block's lookups and a part of its entries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores that a task holds at once.
TILE = 1 << 20


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, added one after the other, so equal vectors have equal scores wherever they stand."""
    out = np.zeros(a.shape[0])
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _units(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vectors have that size and a norm above 0, and these brought to length 1."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.values.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    own = values[vectors.offsets.to_numpy()[rows][:, None] + np.arange(size)].astype("float64")
    norms = np.sqrt(_in_turn(own, own))
    fit = norms > 0
    return rows[fit], own[fit] / norms[fit, None]


def _held(q_ts, e_at, e_until, life) -> np.ndarray | None:
    """Which entries the cache holds at which lookups; None for all at all."""
    if not len(q_ts) or not len(e_at) or e_at.max() <= q_ts.min() and e_until.min() > q_ts.max() and (life is None or q_ts.max() - e_at.min() <= life):
        return None
    t = q_ts[:, None]
    held = (e_at <= t) & (e_until > t)
    return held if life is None else held & (t - e_at <= life)


def best_of_cell(threshold: float, ttl: int, itself: bool, schema: pa.Schema):
    """A function of two Arrow tables: lookups (lookup_id, embedding, _t) and entries (entry_id, embedding, response, _at, _until), times in
    microseconds -> lookup_id, response, score, entry_id, _at of each lookup's best entry. Single precision says which pairs can be the
    best ones, double precision scores them."""
    life = ttl * 1_000_000 if ttl else None

    def tile(q, e, q_ids, e_ids, q_ts, e_at, e_until):
        """(row of q, row of e, score) of the best ones."""
        rough = q.astype("float32") @ e.astype("float32").T
        held = _held(q_ts, e_at, e_until, life)
        if held is not None:
            rough[~held] = -np.inf
        if not itself:
            order = np.argsort(e_ids, kind="stable")
            low, high = (np.searchsorted(e_ids[order], q_ids, side=s) for s in ("left", "right"))
            for r in np.flatnonzero(high > low):
                rough[r, order[low[r] : high[r]]] = -np.inf
        off = (q.shape[1] + 2) * 2.0**-22
        r, c = np.nonzero(rough >= (np.maximum(rough.max(axis=1), threshold) - off).astype("float32")[:, None])
        score = _in_turn(q[r], e[c])
        near = score >= threshold
        r, c, score = r[near], c[near], score[near]
        order = np.lexsort((-e_ids[c], e_at[c], score, r))
        last = order[np.append(np.flatnonzero(np.diff(r[order])), len(order) - 1)] if len(order) else order
        return r[last], c[last], score[last]

    def best(lookups: pa.Table, entries: pa.Table) -> pa.Table:
        out = []
        if lookups.num_rows and entries.num_rows:
            lookups, entries = lookups.combine_chunks(), entries.combine_chunks()
            column = lambda t, c: (v := t.column(c)).chunk(0) if t.column(c).num_chunks else v
            q_v, e_v = column(lookups, "embedding"), column(entries, "embedding")
            sizes = set(np.diff(q_v.offsets.to_numpy())) & set(np.diff(e_v.offsets.to_numpy())) - {0}
            number = lambda t, c: column(t, c).to_numpy(zero_copy_only=False)
            for size in sizes:
                (q_rows, q), (e_rows, e) = _units(q_v, size), _units(e_v, size)
                if not len(q_rows) or not len(e_rows):
                    continue
                e_ids, e_at, e_until = (number(entries, c)[e_rows] for c in ("entry_id", "_at", "_until"))
                q_ids, q_ts = (number(lookups, c)[q_rows] for c in ("lookup_id", "_t"))
                step = max(1, TILE // len(e_rows))
                for at in range(0, len(q_rows), step):
                    own = slice(at, at + step)
                    r, c, score = tile(q[own], e, q_ids[own], e_ids, q_ts[own], e_at, e_until)
                    taken = entries.take(pa.array(e_rows[c]))
                    columns = {"lookup_id": pa.array(q_ids[own][r]), "response": taken.column("response"), "score": pa.array(score), "entry_id": pa.array(e_ids[c]), "_at": pa.array(e_at[c])}
                    out.append(pa.table([columns[f.name] for f in schema], names=schema.names).cast(schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return best
