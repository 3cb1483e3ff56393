"""A run of named stages over saved tables that can stop to ask, check itself, and go on after its driver is gone.

Each stage is a function of the tables made so far and gives one table, which is
written and read again before the next. The tables, and the notes of the run,
stand in a store of units: a stage's table and what it changes of the notes
become visible together, so a driver that dies between two stages, or
within one, leaves a run that another driver takes up where it was.

A run can start at a stage: what comes before it is read from the tables saved,
and that stage and all after it are made anew.

- Questions: before a stage is made it may ask. The run stops, the question is
  kept, and ``answer`` stores what is said to it; the run then goes on, and the
  stage finds the answer in ``answers``.
- Checks: when the stage named by ``check_after`` is made, the rules are tried in
  order of the stages. The first that fails sends the run back to its stage, at
  most ``retries`` times in all; then the result is taken as it is. The count
  is kept with the tables.
- Feedback: ``rerun`` sends a finished run back to a stage, as a review asks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.units import Store, Unit

Tables = dict[str, DataFrame]
Stage = Callable[[Tables], DataFrame]
Rule = Callable[[Tables], bool]


class Workflow:
    def __init__(self, spark: SparkSession, folder: str, stages: dict[str, Stage], questions: dict[str, Callable[[Tables], str | None]] | None = None, rules: dict[str, Rule] | None = None, check_after: str | None = None, retries: int = 2):
        self.spark, self.stages, self.store = spark, stages, Store(spark, folder)
        self.questions, self.rules, self.check_after, self.retries = questions or {}, rules or {}, check_after, retries
        for name in (*self.questions, *self.rules, *([check_after] if check_after else [])):
            self._known(name)
        #: Names of the stages that the last pass made, in order: of the last one, where rules sent the run back.
        self.made: list[str] = []

    # ------------------------------------------------------------ what is kept

    @property
    def answers(self) -> dict[str, str]:
        return self.store.notes().get("answers", {})

    @property
    def question(self) -> dict[str, str] | None:
        """The stage that waits and what it asks; None where nothing is open."""
        return self.store.notes().get("question")

    @property
    def retried(self) -> int:
        return self.store.notes().get("retries", 0)

    @property
    def routes(self) -> list[str]:
        """The stages that the run was sent back to, in order."""
        return self.store.notes().get("routes", [])

    def saved(self, stage: str) -> DataFrame | None:
        return self.store.read(stage)

    # ------------------------------------------------------------ runs

    def answer(self, text: str) -> None:
        """Answer the open question; the next run goes on from it."""
        asked = self.question
        if asked is None:
            raise ValueError("no question is open")
        with self.store.unit() as unit:
            unit.note("answers", {**self.answers, asked["stage"]: text})
            unit.note("question", None)

    def clear(self, stage: str) -> None:
        """Forget one stage's table; those before and after stay."""
        self._known(stage)
        with self.store.unit() as unit:
            unit.drop(stage)

    def run(self, inputs: Tables, start: str | None = None, force: bool = False) -> Tables:
        """Tables of the stages made. Saved ones are used up to ``start``, or up to the first that is missing; ``force`` uses none.

        Where a stage asks, the tables before it are given, and ``question`` tells what it asks.
        """
        if force:
            self._back_to(next(iter(self.stages)), afresh=True)
        elif start is not None:
            self._known(start)
            self._back_to(start)
        while True:
            tables, failed = self._once(inputs)
            if failed is None:
                return tables
            self._back_to(failed, counted=True)

    def _once(self, inputs: Tables) -> tuple[Tables, str | None]:
        """Make what is missing. The stage to go back to, if a rule failed."""
        tables, fresh = dict(inputs), False
        self.made = []
        for name, stage in self.stages.items():
            table = None if fresh else self.saved(name)
            if table is None:
                asks = self.questions.get(name)
                said = asks(tables) if asks and name not in self.answers else None
                if said is not None:
                    with self.store.unit() as unit:
                        unit.note("question", {"stage": name, "text": said})
                        self._drop_from(unit, name)
                    return tables, None
                with self.store.unit() as unit:
                    # what follows a stage that is made anew is out of date
                    self._drop_from(unit, name)
                    unit.write(name, stage(tables))
                    unit.note("checked", False if name == self.check_after else self.store.notes().get("checked", False))
                fresh = True
                self.made.append(name)
                table = self.saved(name)
            tables[name] = table
            if name == self.check_after and not self.store.notes().get("checked", False):
                if self.retried < self.retries:
                    failed = next((s for s in self.stages if s in self.rules and s in tables and not self.rules[s](tables)), None)
                    if failed is not None:
                        return tables, failed
                with self.store.unit() as unit:
                    unit.note("checked", True)
        return tables, None

    def _drop_from(self, unit: Unit, stage: str) -> None:
        names = list(self.stages)
        unit.drop(*names[names.index(stage) :])

    def _back_to(self, stage: str, counted: bool = False, afresh: bool = False) -> None:
        with self.store.unit() as unit:
            self._drop_from(unit, stage)
            if counted:
                unit.note("retries", self.retried + 1)
                unit.note("routes", [*self.routes, stage])
            if afresh:
                unit.state["notes"] = {}

    def rerun(self, inputs: Tables, stage: str) -> Tables:
        """Make one stage and what follows anew, as a review asks."""
        self._known(stage)
        return self.run(inputs, start=stage)

    def validated_run(self, inputs: Tables, rules: dict[str, Rule], retries: int = 1) -> Tables:
        """Run, and check the whole at its end by other rules than the run's own."""
        held = self.rules, self.check_after, self.retries
        self.rules, self.check_after, self.retries = rules, list(self.stages)[-1], self.retried + retries
        try:
            with self.store.unit() as unit:
                unit.note("checked", False)
            return self.run(inputs)
        finally:
            self.rules, self.check_after, self.retries = held

    def _known(self, stage: str) -> None:
        if stage not in self.stages:
            raise ValueError(f"no such stage: {stage}")
