"""Keyed state of the streaming operators: what keys remember, and what they tell as event time passes.

Used with ``transformWithState`` in event time; the state store must be RocksDB
(:data:`traceloom.session.STREAMING`). Rows are grouped by a bucket of their keys, and a bucket keeps what its keys
remember as one value: a call to the state store costs as much as hundreds of rows, so it is made once a bucket and
batch, not once a key. Each processor reads and writes the buckets of a batch only. Moments are microseconds since
1970, so no time zone plays a part.
"""

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a task that are packed together.
PACKED = 500_000


def _timer(micros: int) -> int:
    """The first millisecond at or after a moment."""
    return -(-micros // 1000)


def _sorts(row: tuple) -> tuple:
    """A row as a key that sorts like Spark's ascending order: nulls first."""
    return tuple((v is not None, v) for v in row)


def _cells(rows, columns) -> list[tuple]:
    return [tuple(row[c] for c in columns) for row in rows]


class _Bucket(StatefulProcessor):
    def value(self, state, default):
        return pickle.loads(state.get()[0]) if state.exists() else default

    def keep(self, state, value) -> None:
        state.update((pickle.dumps(value),))

    def close(self) -> None:
        pass


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _plain(table: pa.Table) -> bytes:
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table.combine_chunks())
        return out.getvalue().to_pybytes()


def _sealed(table: pa.Table) -> bytes:
    """A table as few bytes, packed at once: Arrow's own way, a buffer at a time on threads, takes ten times as long."""
    plain = _plain(table)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _opened(sealed: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.decompress(memoryview(sealed)[8:], int.from_bytes(sealed[:8], "little"), "zstd")).read_all()


def pack(batches, at_once: int = PACKED):
    """Rows of ``bucket, endpoint_id, path, micros, ...`` as ``(bucket, first, rows)``, one row a bucket for each ``at_once`` rows.

    A stream hands rows with state to Python one cell at a time; packed, that is done once for hundreds of rows.
    """
    def packed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        buckets = table["bucket"].to_numpy()
        order = np.argsort(buckets, kind="stable")
        table, buckets = table.drop_columns("bucket").take(order), buckets[order]
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        first = np.minimum.reduceat(table["micros"].to_numpy(), starts)
        ends = np.r_[starts[1:], len(buckets)]
        for at in range(0, len(starts), 64):
            own = slice(at, at + 64)
            yield pa.RecordBatch.from_arrays([
                pa.array(buckets[starts[own]], pa.int32()), pa.array(first[own], pa.int64()),
                pa.array([_sealed(table.slice(a, b - a)) for a, b in zip(starts[own], ends[own], strict=True)], pa.binary())],
                names=["bucket", "first", "rows"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= at_once:
            yield from packed(held)
            held, n = [], 0
    if held:
        yield from packed(held)


def unpack(batches):
    """The rows of packed tables."""
    for batch in batches:
        for sealed in batch.column(0):
            yield from _opened(sealed.as_py()).to_batches()


class DigestsInOrder(_Bucket):
    """Observations of the paths of a bucket, each compared with the one before once the watermark has passed them.

    Rows come packed (:func:`pack`) or one by one, wait as they came, and are told packed. A row is its key, its moment
    and the other columns; those in ``numbers`` are whole numbers, the others texts. What comes after its bucket has told
    a later moment is dropped.
    """

    def __init__(self, columns: list[str], numbers: list[str], forget_ms: int | None):
        self.columns, self.numbers, self.forget_ms = columns, numbers, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "paths binary")

    def _table(self, rows) -> pa.Table:
        cells = {c: [r[c] for r in rows] for c in ("endpoint_id", "path", "micros", *self.columns)}
        kinds = {"micros": pa.int64(), **{c: pa.int64() if c in self.numbers else pa.string() for c in self.columns}}
        return pa.table({c: pa.array(v, kinds.get(c)) for c, v in cells.items()})

    def handleInputRows(self, key, rows, timerValues):
        parts, loose, first = [], [], []
        for row in rows:
            if "rows" in row:
                parts.append(bytes(row["rows"]))
                first.append(row["first"])
            else:
                loose.append(row)
                first.append(row["micros"])
        if loose:
            parts.append(_sealed(self._table(loose)))
        self.waiting.appendValue((pickle.dumps(parts),))
        self.handle.registerTimer(max(_timer(min(first)), timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        parts = [_opened(sealed) for part in self.waiting.get() for sealed in pickle.loads(part[0])]
        held = pa.concat_tables(parts).combine_chunks() if parts else None
        due = -(-held["micros"].to_numpy() // 1000) if parts else np.empty(0, np.int64)
        rest = due[due > now]
        if len(rest) < len(due):
            told, known = self.value(self.last, (None, None))
            ready = held.filter(pa.array((due <= now) if told is None else (due <= now) & (due > told)))
            if ready.num_rows:
                known, rows = self._compared(None if known is None else _opened(known), ready)
                self.keep(self.last, (now, _sealed(known)))
                yield from rows
            self.waiting.clear()
            if len(rest):
                self.waiting.appendValue((pickle.dumps([_sealed(held.filter(pa.array(due > now)))]),))
        if len(rest):
            self.handle.registerTimer(int(rest.min()))
        if self.forget_ms is not None:
            self._forget(now)

    def _compared(self, known: pa.Table | None, ready: pa.Table) -> tuple[pa.Table, list[Row]]:
        """The last row of each path, and ``ready``, packed, with what stood before each row."""
        kept = ["endpoint_id", "path", "micros", "hash", "algorithm"]
        n = 0 if known is None else known.num_rows                      # all of them are before what is ready
        both = ready.select(kept) if known is None else pa.concat_tables([known, ready.select(kept)]).combine_chunks()
        host, path = (_codes(both[c]) for c in ("endpoint_id", "path"))
        group, micros = host * (path.max() + 1) + path, both["micros"].to_numpy()
        order = np.lexsort((micros, group))
        same = group[order][1:] == group[order][:-1]
        tied = np.flatnonzero(same & (micros[order][1:] == micros[order][:-1]))
        if len(tied):
            places = np.union1d(tied, tied + 1)
            rows = order[places]
            equal = ready.take(pa.array(rows - n))
            by = [k for c in reversed(self.columns) for k in _sort_keys(equal[c])]
            order[places] = rows[np.lexsort((*by, micros[rows], group[rows]))]
        before = np.full(len(order), -1)
        before[order[1:][same]] = order[:-1][same]
        known = both.take(pa.array(order[np.r_[~same, True]]))
        rows = order[order >= n]
        before = before[rows]
        none = before < 0
        if self.forget_ms is not None:
            none |= micros[rows] - micros[before] > 1000 * self.forget_ms
        previous = both.select(kept[2:]).take(pa.array(np.where(none, 0, before), mask=none))
        told = ready.take(pa.array(rows - n))
        for c in previous.column_names:
            told = told.append_column(f"previous_{c}", previous[c])
        return known, [Row(rows=_sealed(told.slice(at, 5000))) for at in range(0, told.num_rows, 5000)]

    def _forget(self, now: int) -> None:
        told, known = self.value(self.last, (None, None))
        if known is None:
            return
        known = _opened(known)
        until = -(-known["micros"].to_numpy() // 1000) + self.forget_ms + 1
        if (until <= now).any():
            self.keep(self.last, (told, _sealed(known.filter(pa.array(until > now)))))
        if (until > now).any():
            self.handle.registerTimer(int(until[until > now].min()))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, null among them."""
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _sort_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Keys that sort like Spark's ascending order, nulls first; the last one leads."""
    column = column.combine_chunks()
    there = np.asarray(column.is_valid())
    if _is_text(column.type):
        coded = column.dictionary_encode()
        rank = np.empty(len(coded.dictionary) + 1, np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
        return [rank[coded.indices.fill_null(0).to_numpy()], there] if len(coded.dictionary) else [there]
    return [column.fill_null(0).to_numpy(), there]


class _Armed(_Bucket):
    """One timer a bucket: never later than the first moment at which one of its keys is due."""

    def arm(self, armed: int | None, due: int | None) -> int | None:
        """The timer after something is due at ``due``."""
        if due is None or (armed is not None and armed <= due):
            return armed
        self.handle.registerTimer(due)
        return due


class HostStates(_Armed):
    """The hosts of a bucket: of each its newest heartbeat, the state last told, and when it is due to change."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hosts = handle.getValueState("hosts", "hosts binary")

    def _due(self, seen: int) -> int:
        """The first millisecond at which a host last seen then is stale."""
        return seen // 1000 + self.stale_ms + 1

    def handleInitialState(self, key, initialState, timerValues) -> None:
        hosts = {}
        for host, seen, status in sorted(_cells(initialState["hosts"], ["endpoint_id", "micros", "status"]),
                                         key=lambda r: _sorts(r[1:])):
            hosts[host] = (seen, status, "", 0, 1 if seen is None or status == "revoked" else self._due(seen))
        self.keep(self.hosts, (hosts, self.arm(None, min(h[4] for h in hosts.values()))))

    def handleInputRows(self, key, rows, timerValues):
        (hosts, armed), now = self.value(self.hosts, ({}, None)), timerValues.getCurrentWatermarkInMs()
        start, touched = {}, set()
        for name, micros, status in sorted(_cells(rows, ["endpoint_id", "micros", "status"]), key=lambda r: _sorts(r[1:])):
            seen, was, told, change, _ = hosts.get(name, (None, None, "", 0, None))
            first = start.setdefault(name, seen)
            if first is not None and micros <= first:
                continue
            if told == "healthy" and micros // 1000 >= self._due(seen):                     # it was stale before this one came
                told, change = "stale", change + 1
                yield self._told(name, change, told, seen, self._due(seen) * 1000)
            due = self._due(micros)
            state = "revoked" if status == "revoked" else "stale" if due <= now else "healthy"
            if state != told:
                told, change = state, change + 1
                yield self._told(name, change, told, micros, micros)
            hosts[name] = (micros, status, told, change, due if told == "healthy" else None)
            touched.add(name)
        if touched:
            dues = [hosts[name][4] for name in touched if hosts[name][4] is not None]
            self.keep(self.hosts, (hosts, self.arm(armed, min(dues, default=None))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (hosts, _), now = self.value(self.hosts, ({}, None)), timerValues.getCurrentWatermarkInMs()
        for name, (seen, status, told, change, due) in hosts.items():
            if due is None or due > now:
                continue
            state = "revoked" if status == "revoked" else "never_seen" if seen is None else "stale"
            if state != told:
                change += 1
                yield self._told(name, change, state, seen, due * 1000 if state == "stale" else None)
            hosts[name] = (seen, status, state, change, None)
        self.keep(self.hosts, (hosts, self.arm(None, min((h[4] for h in hosts.values() if h[4] is not None), default=None))))

    def _told(self, name, change, state, seen, moment):
        return Row(endpoint_id=name, change=change, state=state, seen=seen, moment=moment)


class FirstRun(_Armed):
    """The paths of a bucket: of each its first run, and the downloads that still wait for it."""

    def __init__(self, keys: list[str], most_ms: int):
        self.keys, self.most = keys, most_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getValueState("paths", "paths binary")

    def _due(self, micros: int, first) -> int:
        """When nothing that comes later can change what is told of a download."""
        latest = micros + self.most
        return _timer(latest if first is None else max(micros, min(first[0], latest)))

    def handleInputRows(self, key, rows, timerValues):
        firsts, waiting, armed = self.value(self.paths, ({}, {}, None))
        touched, n = set(), len(self.keys)
        for row in _cells(rows, [*self.keys, "micros", "record", "event_id", "download"]):
            path, micros, record, event, download = row[:n], *row[n:]
            if download is not None:
                waiting.setdefault(path, []).append((micros, download))
            else:
                run, first = (micros, record, event), firsts.get(path)
                if first is not None and (micros > first[0] or _sorts(run) >= _sorts(first)):
                    continue
                firsts[path] = run
            touched.add(path)
        if touched:
            now = timerValues.getCurrentWatermarkInMs()
            dues = [self._due(micros, firsts.get(path)) for path in touched for micros, _ in waiting.get(path, ())]
            armed = self.arm(armed, max(min(dues), now + 1) if dues else None)
            self.keep(self.paths, (firsts, waiting, armed))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        (firsts, waiting, _), now = self.value(self.paths, ({}, {}, None)), timerValues.getCurrentWatermarkInMs()
        told, rest = Row(*self.keys, "downloaded", "download", "event_id", "ran"), {}
        for path, held in waiting.items():
            first = firsts.get(path)
            for micros, download in held:
                if self._due(micros, first) > now:
                    rest.setdefault(path, []).append((micros, download))
                elif first is not None and first[0] - micros <= self.most:
                    yield told(*path, micros, download, first[2], first[0])
        dues = [self._due(micros, firsts.get(path)) for path, held in rest.items() for micros, _ in held]
        self.keep(self.paths, (firsts, rest, self.arm(None, min(dues, default=None))))
