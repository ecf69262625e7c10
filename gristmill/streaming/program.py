"""The program of drafts, checks and retries over a stream: one state for each request, bounded by the decision table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gristmill.operators.evidence import decided
from gristmill.plans.strategies import DIALOGUE_BUDGET

#: The state store that such programs need; a session's setting.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "passes int, budget int, route string"


class Progress(StatefulProcessor):
    """What a request has used up and where it stands. Verdicts count in the order of their passes, each once; none after the end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passes, budget, route = self.state.get() if self.state.exists() else (0, DIALOGUE_BUDGET, "")
        verdicts = pd.concat(list(rows))  # of one request in one batch; the table bounds how many can count
        out = []
        for _, number, passed, reason, cases in verdicts.sort_values(verdicts.columns[1], kind="stable").itertuples(index=False):
            if route == "training_agent" or number != passes + 1:
                continue
            passes = int(number)
            route = decided(bool(passed), reason, passes - 1 if passed else passes, budget, bool(cases))
            budget -= route == "evidence_subgraph"
            out.append((*key, passes, budget, route, route == "training_agent"))
        if out:
            self.state.update((passes, budget, route))
            yield pd.DataFrame(out, columns=["request", "passes", "budget", "route", "ended"])

    def close(self) -> None:
        pass


def routed(verdicts: DataFrame) -> DataFrame:
    """request, passes, budget, route, ended for each verdict that counts, from a stream of request, pass (from 1), passed, reason, cases.

    A verdict counts if it is that of the request's next pass; one that comes again, one
    out of turn and one after the end change nothing. A request ends where the decision table sends it out,
    at the latest after its retries, so its state is three values whatever comes in.
    """
    kind = verdicts.schema["request"].dataType.simpleString()
    rows = verdicts.selectExpr("request", "cast(`pass` as int) as `pass`", "coalesce(passed, false) as passed", "coalesce(reason, '') as reason", "coalesce(cases, false) as cases")
    return rows.groupBy("request").transformWithStateInPandas(Progress(), f"request {kind}, passes int, budget int, route string, ended boolean", "Append", "None")
