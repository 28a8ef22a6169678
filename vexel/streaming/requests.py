"""Requests carried out once: a stream with each client's last successes as its state."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Successful requests that are remembered of a client, oldest first out, and buckets that clients are dealt to by a hash.
REMEMBERED, BUCKETS = 256, 1024
SERVED = "client string, seq long, req_id string, applied boolean, remembered int"
_STATE = "clients array<string>, held array<int>, ids array<string>"


def serve_requests(requests: DataFrame, keep: int = REMEMBERED, buckets: int = BUCKETS) -> DataFrame:
    """``SERVED`` for a stream of ``client, seq, req_id, ok``: whether each request was carried out (``applied``) or
    answered from memory, and how many the client's memory held afterwards.

    A client's requests are taken in order of ``seq`` within a batch. One whose id is remembered is a retry and is not
    carried out again. A success is remembered, in a first-in first-out state of at most ``keep`` ids a client, whatever
    the length of the stream; a failure is not, so that its retry is carried out. Requests without an id are always
    carried out. The state is Spark's own, so a restart goes on with it. Clients share ``buckets`` states, so that a batch
    costs its rows and not a call for each client; with very many clients take more (a checkpoint keeps its number).
    """

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory: dict[str | None, OrderedDict] = {}
        if state.exists:
            clients, held, ids = state.get
            at = 0
            for client, n in zip(clients, held, strict=True):
                memory[client] = OrderedDict.fromkeys(ids[at : at + n])
                at += n
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        applied, held = [], []
        for client, req, ok in zip(rows.client, rows.req_id, rows.ok, strict=True):
            known = memory.get(client)
            if known is None:
                known = memory[client] = OrderedDict()
            new = req is None or req not in known
            applied.append(new)
            if new and ok and req is not None:
                known[req] = None
                if len(known) > keep:
                    known.popitem(last=False)
            held.append(len(known))
        some = {c: own for c, own in memory.items() if own}
        state.update((list(some), [len(own) for own in some.values()], [r for own in some.values() for r in own]))
        yield pd.DataFrame({"client": rows.client, "seq": rows.seq, "req_id": rows.req_id, "applied": applied, "remembered": held})

    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets)).cast("int")
    return requests.select("client", "seq", "req_id", "ok", bucket.alias("bucket")).groupBy("bucket").applyInPandasWithState(serve, SERVED, _STATE, "append", GroupStateTimeout.NoTimeout)
