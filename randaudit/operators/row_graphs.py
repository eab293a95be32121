"""Graphs of contracts of bounded size, many at a time: numpy steps over all their links or partial paths at once.

Rows are (contract_id, id, target, type, bits, source_type, sink_type), those of a contract next to each other: a node has no target, a link goes from id to target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What bits tell of a node; access and time take two bits each from the places below.
SOURCE, SINK, GAMBLING, FINANCIAL, MIXING = 1, 2, 4, 8, 16
ACCESS, TIME = (5, [None, "admin", "role"]), (7, [None, "short", "long"])

#: Rows that are searched together, about; walks (many times the partial paths, where there are cycles) of the contracts whose paths are held
#: at once, besides those of one contract; paths of a batch that is handed on.
ROWS_AT_ONCE, WALKS_AT_ONCE, PATHS_AT_ONCE = 200_000, 1_000_000, 8192


class Graphs:
    """The links of a batch of contracts by place of their nodes, sorted by start: those of node i are low[i] to high[i]. Links with an unknown end are left out."""

    def __init__(self, batch: pa.RecordBatch, cutoff: int):
        runs = pc.run_end_encode(batch.column("contract_id"))
        self.contracts = runs.values
        of = np.repeat(np.arange(len(runs.values)), np.diff(runs.run_ends.to_numpy(), prepend=0))
        is_node = pc.is_null(batch.column("target"))
        nodes, links, is_node = batch.filter(is_node), batch.filter(pc.invert(is_node)), is_node.to_numpy(zero_copy_only=False)
        self.owner, of = of[is_node], of[~is_node]
        self.names, self.bits = nodes.column("id"), nodes.column("bits").to_numpy()
        self.source_types, self.sink_types = nodes.column("source_type"), nodes.column("sink_type")
        names = pa.concat_arrays([self.names, links.column("id"), links.column("target")]).dictionary_encode()
        own, source, target = np.split(names.indices.to_numpy().astype(np.int64), [len(nodes), len(nodes) + len(links)])
        key, source, target = (c * len(names.dictionary) + x for c, x in ((self.owner, own), (of, source), (of, target)))
        order = np.lexsort((self.bits, key))
        at = lambda k: np.minimum(np.searchsorted(key, k, sorter=order), len(order) - 1)
        place = lambda k: np.where(key[order[at(k)]] == k, order[at(k)], -1)
        self.first, start, to = place(key), place(source), place(target)
        known = np.flatnonzero((start >= 0) & (to >= 0))
        known = known[np.argsort(start[known], kind="stable")]
        self.start, self.to, self.types = start[known], to[known], links.column("type").take(pa.array(known))
        self.low, self.high = (np.searchsorted(self.start, self.first, side) for side in ("left", "right"))
        self.some = self.high > self.low
        self.groups = np.flatnonzero(np.diff(self.start, prepend=-1))
        self.group = np.searchsorted(self.groups, self.low[self.some])
        self.cutoff, self.far = cutoff, np.where(self.has(SINK), 0, cutoff + 1)
        for _ in range(cutoff):  # far: links to the nearest sink, more than the cutoff where none is near
            before, self.far = self.far, self.far.copy()
            self.far[self.some] = np.minimum(before[self.some], 1 + self.over_links(np.minimum, before[self.to]))
            if (before == self.far).all():
                break

    def has(self, bit: int) -> np.ndarray:
        return self.bits & bit != 0

    def over_links(self, fold: np.ufunc, values: np.ndarray) -> np.ndarray:
        """Values of links folded for each node that has links."""
        return fold.reduceat(values, self.groups)[self.group] if len(values) else values

    def by_contract(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=values, minlength=len(self.contracts))

    def walks(self) -> np.ndarray:
        """For each contract, how many walks from its sources can still end at a sink in time: no fewer than its partial paths."""
        counts = np.ones(len(self.far))
        for k in range(self.cutoff, 0, -1):
            more = self.over_links(np.add, np.where(self.far[self.to] + k <= self.cutoff, counts[self.to], 0.0))
            counts = np.ones(len(self.far))
            counts[self.some] += more
        return self.by_contract(np.where(self.has(SOURCE), counts, 0.0))

    def tainted_sinks(self) -> np.ndarray:
        """For each contract, how many sinks some source reaches, by any number of links."""
        reached, n = np.zeros(len(self.far), bool), -1
        reached[self.first[self.has(SOURCE)]] = True
        while n != (n := reached.sum()):
            reached[self.to[reached[self.start]]] = True
        return self.by_contract(self.has(SINK) & reached[self.first])

    def paths(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, links) of all simple paths of chosen contracts from their sources to other nodes that are sinks, a row for each path of one length."""
        nodes = np.flatnonzero(self.has(SOURCE) & (self.far <= self.cutoff) & chosen[self.owner]).astype(np.int32)[:, None]
        links, sink = np.empty((len(nodes), 0), np.int32), self.has(SINK)
        for k in range(1, self.cutoff + 1):
            low, n = self.low[nodes[:, -1]], (self.high - self.low)[nodes[:, -1]]
            row = np.repeat(np.arange(len(nodes)), n)
            link = np.arange(len(row)) + np.repeat(low - (np.cumsum(n) - n), n)
            near = self.far[self.to[link]] + k <= self.cutoff
            row, link = row[near], link[near]
            new = (self.first[nodes[row]] != self.to[link][:, None]).all(1)
            row, link = row[new], link[new]
            nodes = np.column_stack([nodes[row], self.to[link]]).astype(np.int32)
            links = np.column_stack([links[row], link]).astype(np.int32)
            if not len(nodes):
                return
            ends = np.flatnonzero(sink[nodes[:, -1]])
            for at in range(0, len(ends), PATHS_AT_ONCE):
                yield nodes[ends[at : at + PATHS_AT_ONCE]], links[ends[at : at + PATHS_AT_ONCE]]

    def told(self, nodes: np.ndarray, links: np.ndarray) -> dict[str, pa.Array]:
        """Paths as columns of taint.FOUND."""
        lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * n), values)
        named = lambda places: self.names.take(pa.array(places.ravel()))
        flags, k = self.bits[nodes], links.shape[1]

        def first_of(kind: tuple[int, list]) -> pa.Array:
            codes = flags >> kind[0] & 3
            return pa.array(kind[1], pa.string()).take(pa.array(codes[np.arange(len(codes)), (codes != 0).argmax(1)]))

        return {
            "contract_id": self.contracts.take(pa.array(self.owner[nodes[:, 0]])),
            "source": named(nodes[:, 0]),
            "sink": named(nodes[:, -1]),
            "path": lists(named(nodes), k + 1),
            "types": lists(self.types.take(pa.array(links.ravel())), k),
            **{c: pa.array((flags & bit).any(1)) for c, bit in (("gambling", GAMBLING), ("financial", FINANCIAL), ("mixing", MIXING))},
            "access": first_of(ACCESS),
            "time": first_of(TIME),
            "path_length": pa.array(np.full(len(nodes), k + 1, np.int32)),
            "contains_loop": pa.array(np.zeros(len(nodes), bool)),
            "source_type": self.source_types.take(pa.array(nodes[:, 0])),
            "sink_type": self.sink_types.take(pa.array(nodes[:, -1])),
        }


def whole_contracts(batches: Iterator[pa.RecordBatch], at_once: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many rows at least that end where a contract ends."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= at_once:
            rows = joined()
            ends = pc.run_end_encode(rows.column("contract_id")).run_ends
            last = ends[-2].as_py() if len(ends) > 1 else 0
            held, n = [rows.slice(last)], n - last
            if last:
                yield rows.slice(0, last)
    if n:
        yield joined()


def searched(batches: Iterator[pa.RecordBatch], cutoff: int, most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row with walks and tainted_sinks for each contract, and one for each path of the contracts with at most so many walks; other columns are null.

    The paths of several contracts are made together, up to a bound of walks.
    """

    def row(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(columns["contract_id"])
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

    for batch in whole_contracts(batches):
        graphs = Graphs(batch, cutoff)
        walks = graphs.walks()
        yield row({"contract_id": graphs.contracts, "walks": pa.array(walks), "tainted_sinks": pa.array(graphs.tainted_sinks().astype(np.int64))})
        turn = np.cumsum(np.where(walks <= most, walks, 0)) // WALKS_AT_ONCE
        for k in np.unique(turn):
            for nodes, links in graphs.paths((turn == k) & (walks <= most)):
                yield row(graphs.told(nodes, links))
