"""Units of work and runs that stop, ask, check themselves and go on."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.workflow import Workflow
from palimpsest.sources import store
from palimpsest.sources.units import Conflict, Store, Unit

STEPS = ("data", "claim", "manifest", "rename", "end")


def ids(frame):
    return sorted(r["id"] for r in frame.collect())


def test_all_of_a_unit_or_nothing(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    assert db.read("a") is None and db.names() == [] and db.version() == 0
    with db.unit() as u:
        u.write("a", spark.range(3))
        u.append("b", spark.range(2))
        assert db.read("a") is None and ids(u.read("a")) == [0, 1, 2]
        u.note("n", 1)
    assert db.names() == ["a", "b"] and db.notes() == {"n": 1} and db.version() == 1
    with pytest.raises(ZeroDivisionError), db.unit() as u:
        u.write("a", spark.range(9))
        u.note("n", 2)
        1 / 0  # noqa: B018
    assert ids(db.read("a")) == [0, 1, 2] and db.notes() == {"n": 1}
    with db.unit() as u:
        u.append("b", spark.range(5, 6))
        u.write("a", u.read("a").filter("id > 0"))
        u.drop("none")
    assert ids(db.read("a")) == [1, 2] and ids(db.read("b")) == [0, 1, 5] and ids(db.read("a", 1)) == [0, 1, 2]
    assert db.vacuum(1) == 2 and ids(db.read("b")) == [0, 1, 5]


@pytest.mark.parametrize("step", STEPS)
def test_failure_before_each_step(spark, tmp_path, monkeypatch, step):
    """The state is the old or the new one, whole, at every step, and the next unit works."""
    db = Store(spark, str(tmp_path / "db"))
    with db.unit() as u:
        u.write("a", spark.range(2))
        u.write("b", spark.range(2))

    def dies(self, name):
        if name == step:
            raise KeyboardInterrupt(name)

    with monkeypatch.context() as m:
        m.setattr(Unit, "_step", dies)
        with pytest.raises(KeyboardInterrupt), db.unit() as u:
            u.write("a", spark.range(5))
            u.write("b", spark.range(5))
    other = Store(spark, str(tmp_path / "db"))
    new = step == "end"
    assert (ids(other.read("a")), ids(other.read("b"))) == ((list(range(5)),) * 2 if new else ([0, 1],) * 2)
    monkeypatch.setattr("palimpsest.sources.units.STALE", 0)
    with other.unit() as u:
        u.append("a", spark.range(7, 8))
    assert ids(db.read("a"))[-1] == 7 and len(ids(db.read("b"))) == (5 if new else 2)


def test_savepoints(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    with db.unit() as u:
        u.write("a", spark.range(1))
        with pytest.raises(ValueError), u.nested():
            u.write("a", spark.range(4))
            u.write("b", spark.range(4))
            with pytest.raises(KeyError), u.nested():
                u.note("x", 1)
                raise KeyError
            assert "x" not in u.state["notes"] and len(ids(u.read("b"))) == 4
            raise ValueError
        with u.nested():
            u.append("a", spark.range(8, 9))
        assert db.version() == 0
    assert ids(db.read("a")) == [0, 8] and db.names() == ["a"]


def test_units_that_meet(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"))
    first, second = Unit(db), Unit(db)
    first.write("a", spark.range(1))
    second.write("a", spark.range(2))
    assert second.safe_commit() and not first.safe_commit()
    with pytest.raises(Conflict):
        late = Unit(db)
        db._fs.create(db._path(f"claims/{db.version() + 1:012d}"), False).close()
        late.note("x", 1)
        late.commit()
    with db.manual() as u:
        u.write("a", spark.range(9))
    assert ids(db.read("a")) == [0, 1]


def test_a_swap_that_broke_off_is_put_right(spark, tmp_path):
    path = str(tmp_path / "t")
    store.staged_write(spark.range(2), path)
    (tmp_path / "t").rename(tmp_path / "t-old")
    assert store.recover(spark, path) and ids(spark.read.parquet(path)) == [0, 1]
    store.staged_write(spark.range(3), path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2] and not store.recover(spark, path)


def flow(spark, folder, log, dies=(), good_after=99, asks=True):
    def stage(name, before=None):
        def run(tables):
            if name in dies:
                raise KeyboardInterrupt(name)
            log.append(name)
            said = box[0].answers.get(name, "")
            base = tables[before] if before else tables["input"]
            return base.withColumn(name, F.lit(f"{said}{log.count(name)}"))

        return run

    stages = {"detect": stage("detect"), "map": stage("map", "detect"), "score": stage("score", "map"), "report": stage("report", "score"), "translate": stage("translate", "report")}
    rules = {"map": lambda t: int(t["map"].first()["map"][-1]) >= good_after, "score": lambda t: True}
    box = [Workflow(spark, folder, stages, {"report": lambda t: f"publish {t['score'].count()} rows?"} if asks else {}, rules, "score")]
    return box[0]


def test_a_run_asks_checks_and_goes_on_elsewhere(spark, tmp_path):
    """Every step by a driver of its own: nothing but the folder is passed on."""
    inputs, log, folder = {"input": spark.range(3)}, [], str(tmp_path / "run")
    with pytest.raises(KeyboardInterrupt):
        flow(spark, folder, log, dies=("score",)).run(inputs)
    assert log == ["detect", "map"]
    first = flow(spark, folder, log, good_after=2)
    tables = first.run(inputs)
    # the rule sent the run back to "map" once, then the report asked
    assert log == ["detect", "map", "score", "map", "score"] and "report" not in tables
    second = flow(spark, folder, log, good_after=2)
    assert second.question == {"stage": "report", "text": "publish 3 rows?"} and second.retried == 1 and second.routes == ["map"]
    assert "report" not in second.run(inputs) and len(log) == 5
    second.answer("yes")
    assert second.question is None
    third = flow(spark, folder, log, good_after=2)
    rows = third.run(inputs)["translate"].first()
    assert rows["report"] == "yes1" and log[5:] == ["report", "translate"] and third.retried == 1
    with pytest.raises(ValueError):
        third.answer("again")
    assert third.rerun(inputs, "score") and third.made == ["score", "report", "translate"]


def test_checks_give_up_after_their_retries(spark, tmp_path):
    inputs, log, folder = {"input": spark.range(1)}, [], str(tmp_path / "run")

    class Gone(BaseException):
        pass

    once = flow(spark, folder, log, asks=False)
    back, count = once._back_to, []

    def dies(stage, **k):
        back(stage, **k)
        count.append(stage)
        if len(count) == 1:
            raise Gone

    once._back_to = dies
    with pytest.raises(Gone):
        once.run(inputs)
    # the driver is gone after the first retry was counted; the next one has one left
    done = flow(spark, folder, log, asks=False)
    assert "translate" in done.run(inputs) and done.retried == 2 and done.routes == ["map", "map"] and log.count("map") == 3
    assert done.run(inputs) and done.made == []
