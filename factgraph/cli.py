"""Command line over a store of tables.

``python -m factgraph.cli init STORE`` makes the empty tables and a configuration, ``status STORE`` lists the documents' states,
``logs STORE PATH`` shows a document's state and what went wrong, ``query STORE TEXT [DEPTH]`` asks the graph.
"""

from __future__ import annotations

import sys

from .functions import predicates as P
from .operators import metrics, retrieve
from .session import get_session
from .sources.files import Config, Store
from .sources.sinks import RETRY_LOG, RetryLog, lines

#: Empty tables of a new store.
TABLES = {
    "states": "path string, status string, current_stage string, retry_count int, last_error string, next_retry_at timestamp_ntz, completed_chunks string, total_chunks long, checksum string, updated_at timestamp_ntz",
    "retry_log": RETRY_LOG,
    "aliases": "source string, target string",
}


def init(store: Store, config: str | None = None) -> list[str]:
    """Make what is not there yet; returns the names."""
    made = [n for n in (*TABLES, "active") if not store.exists(n)]
    for name in made:
        store.write(name, P.seed(store.spark) if name == "active" else store.spark.createDataFrame([], TABLES[name]))
    if config:
        Config.load(config).save(config)
    return made


def status(store: Store) -> list[str]:
    rows = metrics.status_list(store.read("states")).orderBy("path").toLocalIterator()
    return [f"{r['path']}  {r['status']} ({r['bucket']})  {r['done']}/{r['total_chunks']}" for r in rows]


def logs(store: Store, path: str) -> list[str]:
    """A document's state and its failed attempts, by its path or, failing that, its file name."""
    state = metrics.find_state(store.read("states"), path).first()
    if state is None:
        return [f"{path} is not known"]
    head = [f"{k}: {v}" for k, v in state.asDict().items() if v is not None]
    return head + [lines(r) for r in RetryLog(store).of(state["path"]).toLocalIterator()]


def query(store: Store, text: str, depth: int = 1) -> list[str]:
    hits = retrieve.query_graph(store.read("assertions"), text, depth, cap=retrieve.HOP_CAP, edge_cap=retrieve.HOP_CAP)
    return [r["line"] for r in retrieve.render_hits(hits).collect()] or ["(no results)"]


def main(args: list[str]) -> int:
    least = {"init": 2, "status": 2, "logs": 3, "query": 3}
    if not args or len(args) < least.get(args[0], 1 << 30):
        print(__doc__)
        return 2
    store = Store(get_session("factgraph-cli"), args[1])
    if args[0] == "init":
        out = [f"made {n}" for n in init(store)]
    elif args[0] == "status":
        out = status(store)
    elif args[0] == "logs":
        out = logs(store, args[2])
    else:
        out = query(store, args[2], int(args[3]) if len(args) > 3 else 1)
    print("\n".join(out))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
