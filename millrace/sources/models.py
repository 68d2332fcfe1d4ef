"""Models in numbered versions, one of them adopted, with a way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.versions import Log

HISTORY = "turn bigint, version bigint, event string, reasons array<string>"


class ModelStore:
    """`versions` holds the models, small JSON values; `turns` what was adopted when. A turn appears in one step.

    Readers take the model of the last turn, so they see the old model or the new one and never a mixture.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.versions, self.turns = Log(spark, f"{path}/versions"), Log(spark, f"{path}/turns")

    def put(self, model: dict) -> int:
        """Stores a model without adopting it and gives its version."""
        return self.versions.append({"model": model})

    def model(self, version: int) -> dict:
        return self.versions.get(version)["model"]

    def adopted(self) -> int | None:
        """The version in use; none before the first."""
        last = self.turns.last()
        return None if last is None else last["version"]

    def _turn(self, version: int | None, event: str, reasons: list[str] = ()) -> None:
        number = (self.turns.numbers() or [-1])[-1] + 1
        self.turns.append({"turn": number, "version": version, "event": event, "reasons": list(reasons)})

    def adopt(self, version: int) -> None:
        self.model(version)
        self._turn(version, "adopted")

    def roll_back(self, reasons: list[str] = ()) -> int | None:
        """Back to what was in use before the version in use now was adopted; nothing before that leaves no model."""
        stack: list[int | None] = []
        for turn in map(self.turns.get, self.turns.numbers()):
            if turn["event"] == "adopted":
                stack.append(turn["version"])
            elif turn["event"] == "rolled back" and stack:
                stack.pop()
        before = stack[-2] if len(stack) > 1 else None
        self._turn(before, "rolled back", reasons)
        return before

    def refresh(self, train: Callable[[], dict], measure: Callable[[dict | None], DataFrame], guard: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[int, list[str]]:
        """Trains a model, puts it in use, and rolls it back where the guard has a reason; the version and the reasons.

        `measure` gives the metrics of a model (None: without one), `guard` the reasons (reason) against going from the first to
        the second. The metrics before are taken first.
        """
        now = self.adopted()
        before = measure(None if now is None else self.model(now))
        version = self.put(train())
        self.adopt(version)
        reasons = sorted(r["reason"] for r in guard(before, measure(self.model(version))).collect())  # one row a query at most
        if reasons:
            self.roll_back(reasons)
        return version, reasons

    def history(self) -> DataFrame:
        """(turn, version, event, reasons)."""
        return self.turns.table(HISTORY)
