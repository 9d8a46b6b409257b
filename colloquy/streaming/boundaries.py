"""Identity tables at session boundaries, each carried on from the one before.

A case's state is what the last boundary knew: how many turns each acoustic label has
and how often each name was claimed for it.  The turns of a session are added to
it, and when the next session begins the identity table is emitted as it stands, under
the next version.  Nothing heard earlier is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "case_id string, version int, session_id string, label string, name string, stable string, n_turns bigint, claims bigint"
TURN_COLUMNS = ["case_id", "session_no", "turn_idx", "session_id", "label", "claim"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Boundaries(StatefulProcessor):
    """Counts per case: an open session, turns per label, claims per label and name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "session_no bigint, session_id string, version int")
        self._labels = handle.getListState("labels", "label string, n bigint")
        self._claims = handle.getListState("claims", "label string, name string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows), ignore_index=True).sort_values(["session_no", "turn_idx"], kind="stable")
        opened = self._open.get()
        number, session, version = opened if opened is not None else (None, None, 0)
        labels = dict(self._labels.get())
        claims = {(label, name): n for label, name, n in self._claims.get()}
        for no, chunk in turns.groupby("session_no", sort=True):
            if number is not None and no < number:
                raise ValueError(f"session {no} of case {key[0]} comes after session {number}")
            if number is not None and no != number:
                version += 1
                yield self._table(key[0], version, session, labels, claims)
            number, session = int(no), chunk["session_id"].iloc[0]
            for label, n in chunk.groupby("label").size().items():
                labels[label] = labels.get(label, 0) + int(n)
            named = chunk[chunk["claim"].notna() & (chunk["claim"] != "")]
            for pair, n in named.groupby(["label", "claim"]).size().items():
                claims[pair] = claims.get(pair, 0) + int(n)
        self._open.update((number, session, version))
        self._labels.put(sorted(labels.items()))
        if claims:  # a state store holds no empty list
            self._claims.put([(*pair, n) for pair, n in sorted(claims.items())])

    @staticmethod
    def _table(case: str, version: int, session: str, labels: dict, claims: dict) -> pd.DataFrame:
        """Most claimed name per label, longer and then smaller on ties; labels of one name share the smallest of them."""
        best: dict[str, tuple] = {}
        for (label, name), n in claims.items():
            mark = (-n, -len(name), name)
            best[label] = min(best.get(label, mark), mark)
        heads: dict[str, str] = {}
        for label in sorted(labels):
            if label in best:
                heads.setdefault(best[label][2], label)
        rows = [(case, version, session, label, *((best[label][2], heads[best[label][2]]) if label in best else (None, label)), n, -best[label][0] if label in best else 0) for label, n in sorted(labels.items())]
        return pd.DataFrame(rows, columns=["case_id", "version", "session_id", "label", "name", "stable", "n_turns", "claims"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that list state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def boundary_stream(turns: DataFrame) -> DataFrame:
    """One identity table per case and finished session.

    ``turns(case_id, session_no, turn_idx, session_id, label, claim)``: ``claim`` is a name
    that the turn gives its label, or null.  Sessions of a case come in order.  A
    session is finished when a later one of its case begins.
    """
    return turns.select(*TURN_COLUMNS).groupBy("case_id").transformWithStateInPandas(Boundaries(), OUTPUT, "append", "none")


def payload(turns: DataFrame, tables: DataFrame) -> DataFrame:
    """Every turn of a finished session with the identity its label had at the session's boundary."""
    known = tables.select("case_id", "session_id", "label", "version", "name", "stable")
    return turns.join(known, ["case_id", "session_id", "label"])
