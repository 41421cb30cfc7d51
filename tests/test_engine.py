import pytest

from skein.changes import ChangeSet, Operation
from skein.engine import Engine
from skein.errors import ConstraintError, HandleError, HookError, LogError, QueryError, RecoveryError, SchemaError, TransactionError
from skein.functions.predicates import where
from skein.plans.view import QuerySpec
from skein.schema import SchemaBuilder
from skein.types import Change, Index, Origin, Stage, TransactionState, ValueType

I, S = ValueType.INT64, ValueType.STRING
N = Index.NORMAL


class World:
    def __init__(self, spark, hooks=()):
        b = SchemaBuilder()
        self.doc = b.create_table("Doc")
        self.name = self.doc.add_column("name", S, index=Index.UNIQUE, nullable=False, default="")
        self.value = self.doc.add_column("value", I, index=N, default=0, check=lambda v: v <= 100, check_sql="value <= 100")
        self.twice = self.doc.add_computed_column("twice", I, [self.value], compute=lambda v: None if v is None else 2 * v, compute_sql="2 * value", index=N)
        self.line = b.create_list("Line")
        self.text = self.line.add_column("text", S, index=N)
        self.of = self.line.set_association("doc", self.doc.handle)
        self.note = b.create_table("Note")
        self.body = self.note.add_column("body", S, index=Index.UNIQUE)
        self.on = self.note.add_association("line", self.line.handle)
        for stage, f in hooks:
            self.doc.add_hook(stage, lambda c, s, f=f: f(self, c, s))
        self.e = Engine(spark, b.freeze())

    def doc_with(self, t, name, *texts):
        d = t.insert(self.doc.handle, {self.name: name})
        return d, [t.insert(self.line.handle, d, i, {self.text: x}) for i, x in enumerate(texts)]

    def lines(self, d):
        rows = self.e.query(self.line.handle, QuerySpec(where(self.of, "=", d))).to_rows()
        assert [r.list_index for r in rows] == list(range(len(rows)))
        return [r.text for r in rows]

    def state(self):
        return {h.name: sorted(map(str, self.e.frame(h).collect())) for h in (self.doc.handle, self.line.handle, self.note.handle)}


@pytest.fixture
def w(spark):
    return World(spark)


def test_schema_checks():
    b = SchemaBuilder()
    with pytest.raises(SchemaError):
        b.freeze()
    t = b.create_table("T")
    x, s = t.add_column("x", I), t.add_column("s", S, index=N)
    for bad in (lambda: t.add_column("n", ValueType.NULL), lambda: t.add_range_index([x, s]), lambda: t.add_ordered_index([]), lambda: t.add_interval_index(x, s), lambda: t.add_hook(Stage.BEFORE_APPLY, None)):
        with pytest.raises(SchemaError):
            bad()
    with pytest.raises(SchemaError):
        SchemaBuilder().create_list("L").owner.freeze()
    schema = b.freeze()
    with pytest.raises(SchemaError):
        t.add_column("late", I)
    assert schema.matches(schema.structure()) and not schema.matches("[]")


def test_one_writer_and_states(w):
    t = w.e.begin()
    with pytest.raises(TransactionError):
        w.e.begin()
    t.commit()
    assert t.state is TransactionState.COMMITTED
    for late in (t.commit, t.rollback, lambda: t.insert(w.doc.handle, {})):
        with pytest.raises(TransactionError):
            late()


def test_defaults_computed_and_updates(w):
    with w.e.transaction() as t:
        d = t.insert(w.doc.handle, {w.name: "a", w.value: 4})
        assert w.e.read(d, w.twice) == 8  # uncommitted changes are seen
        t.update(d, w.value, 10)
        t.update(d, {w.name: "b", w.value: 11})
    assert w.e.read(d).values == {"name": "b", "value": 11, "twice": 22}
    with pytest.raises(QueryError):
        w.e.read(10**9)
    assert not w.e.contains(10**9)


@pytest.mark.parametrize(
    "act",
    [
        lambda w, t, d: t.insert(w.doc.handle, {w.name: "a"}),  # unique
        lambda w, t, d: t.update(d, w.name, None),
        lambda w, t, d: t.update(d, w.value, 101),
        lambda w, t, d: t.update(d, w.value, "x"),
        lambda w, t, d: t.update(d, w.twice, 1),
        lambda w, t, d: t.update(d, [(w.value, 1), (w.value, 2)]),
        lambda w, t, d: t.insert(w.line.handle, d, 5, {w.text: "far"}),
        lambda w, t, d: t.insert(w.line.handle, 999, 0, {w.text: "nowhere"}),
        lambda w, t, d: t.insert(w.note.handle, {w.on: d}),  # of another container
    ],
)
def test_a_failure_undoes_the_transaction(w, act):
    with w.e.transaction() as t:
        d, _ = w.doc_with(t, "a", "x")
    before = w.state()
    t = w.e.begin()
    t.insert(w.doc.handle, {w.name: "other"})
    with pytest.raises(ConstraintError):
        act(w, t, d)
    assert t.state is TransactionState.FAILED and w.state() == before
    t.rollback()
    w.e.begin().rollback()


def test_handles_of_another_schema(w, spark):
    other = World(spark)
    with pytest.raises(HandleError):
        w.e.view(other.doc.handle)


def test_unique_within_a_parent(w):
    with w.e.transaction() as t:
        d, (x, y) = w.doc_with(t, "a", "x", "y")
        t.insert(w.note.handle, {w.body: "same", w.on: x})
        t.insert(w.note.handle, {w.body: "same", w.on: y})
        t.insert(w.note.handle, {w.body: "same"})
        t.insert(w.note.handle, {w.body: "same"})  # without a parent there is no scope
        t.insert(w.note.handle, {w.on: x})
        t.insert(w.note.handle, {w.on: x})  # nulls are not unique
    with pytest.raises(ConstraintError), w.e.transaction() as t:
        t.insert(w.note.handle, {w.body: "same", w.on: x})


def test_lists(w):
    with w.e.transaction() as t:
        d, ids = w.doc_with(t, "a", *"01234")
        e, _ = w.doc_with(t, "b", "z")
    assert w.lines(d) == list("01234") and w.e.list_length(w.line.handle, d) == 5
    with w.e.transaction() as t:
        t.rotate(w.line.handle, d, 0, 5, 2)
    assert w.lines(d) == list("23401")
    w.e.undo()
    with w.e.transaction() as t:
        t.rotate(w.line.handle, d, 0, 5, -1)
    assert w.lines(d) == list("40123")
    w.e.undo()
    with w.e.transaction() as t:
        t.insert(w.line.handle, d, 2, {w.text: "new"})
        t.remove_at(w.line.handle, d, 0)
        t.update(ids[4], w.of, e, target_index=0)  # to another list
        t.update(ids[3], w.of, d, target_index=0)  # within one: the place counts after it has left
        t.update(ids[1], w.of, None)
    assert w.lines(d) == ["3", "new", "2"] and w.lines(e) == ["4", "z"]
    assert w.e.list_length(w.line.handle, None) == 1
    w.e.undo()
    assert w.lines(d) == list("01234") and w.lines(e) == ["z"]
    w.e.redo()
    assert w.lines(d) == ["3", "new", "2"] and w.lines(e) == ["4", "z"]
    t = w.e.begin()
    for bad in (lambda: t.remove_at(w.line.handle, d, 9), lambda: t.rotate(w.line.handle, d, 1, 9, 1)):
        with pytest.raises(QueryError):
            bad()
    t.rollback()


def test_cascade_and_undo(w):
    with w.e.transaction() as t:
        d, (x, y) = w.doc_with(t, "a", "x", "y")
        e, _ = w.doc_with(t, "b", "k")
        n = t.insert(w.note.handle, {w.body: "n", w.on: y})
    before = w.state()
    with w.e.transaction() as t:
        t.remove(d)
    assert [(o.kind, o.item_id) for o in t.change_set.operations] == [(Change.ITEM_REMOVED, d), (Change.CASCADE_REMOVED, x), (Change.CASCADE_REMOVED, y), (Change.CASCADE_REMOVED, n)]
    assert w.e.view(w.line.handle).count() == 1 and w.e.view(w.note.handle).empty()
    w.e.undo()
    assert w.state() == before and w.lines(d) == ["x", "y"]
    with pytest.raises(ConstraintError), w.e.transaction() as t:
        t.remove_at(w.line.handle, d, 1)  # its note would dangle
    with w.e.transaction() as t:
        t.remove_at(w.line.handle, d, 0)
    assert w.lines(d) == ["y"]


def test_undo_steps(w):
    with w.e.transaction() as t:
        t.insert(w.doc.handle, {w.name: "a"})
    assert w.e.can_undo and not w.e.can_redo
    with w.e.transaction() as t:
        d = t.insert(w.doc.handle, {w.name: "b"})
        t.insert(w.doc.handle, {w.name: "c"})
    assert len(w.e.undo_history()) == 1  # several plain inserts are no step
    with w.e.transaction(undoable=False) as t:
        t.update(d, w.value, 5)
    assert len(w.e.undo_history()) == 1
    with w.e.transaction() as t:
        t.update(d, w.value, 6)
    assert w.e.undo().origin is Origin.UNDO and w.e.read(d, w.value) == 5 and w.e.read(d, w.twice) == 10 and w.e.can_redo
    with w.e.transaction() as t:
        t.update(d, w.value, 7)
    assert not w.e.can_redo
    w.e.clear_undo_history()
    with pytest.raises(TransactionError):
        w.e.undo()


def test_hooks_and_events(spark):
    seen = []

    def mirror(w, c, change):
        for o in change.operations:
            if o.kind is Change.COLUMN_UPDATED and o.column == "name":
                c.update(o.item_id, w.value, 42)
                c.insert(w.note.handle, {w.body: f"renamed to {o.new}"})

    w = World(spark, [(Stage.BEFORE_APPLY, mirror), (Stage.AFTER_COMMIT, lambda w, c, s: seen.append(len(s.operations)))])
    events = []
    sub = w.e.subscribe(lambda x: events.append((x.stage, x.origin)))
    with w.e.transaction() as t:
        d = t.insert(w.doc.handle, {w.name: "a"})
        t.update(d, w.name, "b")
    assert w.e.read(d).values == {"name": "b", "value": 42, "twice": 84}
    assert [r.body for r in w.e.view(w.note.handle).to_rows()] == ["renamed to b"]
    kinds = [o.kind for o in t.change_set.operations]
    assert kinds == [Change.ITEM_INSERTED, Change.ITEM_INSERTED, Change.COLUMN_UPDATED, Change.COLUMN_UPDATED, Change.COMPUTED_UPDATED]
    assert t.change_set.links == [(2, 1), (2, 3), (2, 4)]
    assert seen == [4] and events[-1] == (Stage.AFTER_COMMIT, Origin.NORMAL)
    w.e.undo()
    assert events[-1] == (Stage.AFTER_COMMIT, Origin.UNDO) and not w.e.contains(d)
    t = w.e.begin()
    t.insert(w.doc.handle, {w.name: "c"})
    t.rollback()
    assert events[-1][0] is Stage.ROLLBACK
    sub.disconnect()
    assert not sub.connected
    late = World(spark, [(Stage.AFTER_APPLY, lambda w, c, s: c.insert(w.note.handle, {}))])
    with pytest.raises(HookError), late.e.transaction() as t:
        t.insert(late.doc.handle, {late.name: "a"})
    endless = World(spark, [(Stage.BEFORE_APPLY, lambda w, c, s: c.insert(w.doc.handle, {w.name: f"n{c.engine._next}"}))])
    with pytest.raises(HookError), endless.e.transaction() as t:
        t.insert(endless.doc.handle, {endless.name: "a"})
    assert endless.e.view(endless.doc.handle).empty()


def test_change_sets(w, spark, tmp_path):
    with w.e.transaction() as t:
        d, _ = w.doc_with(t, "a", "x", "y")
        for v in (1, 2, 3):
            t.update(d, w.value, v)
        t.rotate(w.line.handle, d, 0, 2, 1)
    whole = t.change_set
    merged = ChangeSet.merge([whole, ChangeSet()])
    updates = [o for o in merged.operations if o.kind is Change.COLUMN_UPDATED]
    assert [(o.old, o.new) for o in updates] == [(0, 3)] and len(whole.operations) > len(merged.operations)
    back = ChangeSet.deserialize(whole.serialize())
    assert back == whole and ChangeSet.from_frame(whole.to_frame(spark)).operations == whole.operations
    for broken in (b"", b"junk", whole.serialize()[:-3]):
        with pytest.raises(LogError):
            ChangeSet.deserialize(broken)
    state = w.state()
    w.e.replay(whole.invert())
    assert all(not v for v in w.state().values())
    for again in (merged, whole):
        w.e.replay(again)
        assert w.state() == state
        w.e.replay(again.invert())
    with pytest.raises(RecoveryError):
        w.e.replay(ChangeSet([Operation(Change.ITEM_REMOVED, 0, 12345)]))
    folder = str(tmp_path / "log")
    w.e.append_log(type("R", (), {"change_set": whole})(), folder, 1)
    w.e.replay_log(folder)
    assert w.state() == state


def test_snapshot(w, spark, tmp_path):
    with w.e.transaction() as t:
        d, ids = w.doc_with(t, "a", "x", "y", "z")
    w.e.create_snapshot(str(tmp_path / "one"))
    state = w.state()
    with w.e.transaction() as t:
        t.remove(d)
    w.e.restore_snapshot(str(tmp_path / "one"))
    assert w.state() == state and not w.e.can_undo
    with w.e.transaction() as t:  # rows of the base are changed in the overlay
        t.insert(w.line.handle, d, 1, {w.text: "new"})
        t.update(d, w.value, 9)
        t.remove(ids[2])
    assert w.lines(d) == ["x", "new", "y"]
    w.e.compact()
    assert w.lines(d) == ["x", "new", "y"] and w.e.read(d, w.twice) == 18
    w.e.undo()
    assert w.state() == state
    with w.e.transaction() as t:
        assert t.insert(w.doc.handle, {w.name: "later"}) > max(ids)
    with pytest.raises(RecoveryError):
        w.e.restore_snapshot(str(tmp_path / "none"))
    b = SchemaBuilder()
    b.create_table("Else")
    with pytest.raises(RecoveryError):
        Engine(spark, b.freeze()).restore_snapshot(str(tmp_path / "one"))


def test_bulk_load(w, spark):
    rows = spark.createDataFrame([(f"n{i:03}", i) for i in range(90)], "name string, value bigint")
    w.e.insert_many(w.doc.handle, rows, order_by=["name"])
    found = w.e.view(w.doc.handle).to_rows()
    assert [(r.name, r.twice) for r in found] == [(f"n{i:03}", 2 * i) for i in range(90)]
    assert [r.item_id for r in found] == list(range(found[0].item_id, found[0].item_id + 90))
    for bad in ([("n001", 1)], [(None, 1)], [("fresh", 101)]):
        with pytest.raises(ConstraintError):
            w.e.insert_many(w.doc.handle, spark.createDataFrame(bad, "name string, value bigint"), order_by=["value"])
    with pytest.raises(ConstraintError), w.e.transaction() as t:
        t.insert(w.doc.handle, {w.name: "n050"})
    assert w.e.view(w.doc.handle).count() == 90


def test_special_indexes(spark):
    b = SchemaBuilder()
    group = b.create_table("Group")
    item = b.create_table("Item")
    rank, sub, start, end = (item.add_column(n, I) for n in ("rank", "subrank", "start", "end"))
    of = item.add_association("group", group.handle, nullable=False)
    order = item.add_ordered_index([rank, sub], [of])
    span = item.add_interval_index(start, end, [of])
    e = Engine(spark, b.freeze())
    with e.transaction() as t:
        g, k = t.insert(group.handle, {}), t.insert(group.handle, {})
        put = lambda x, *v: t.insert(item.handle, {of: x, rank: v[0], sub: v[1], start: v[2], end: v[3]})
        a, b_, c = put(g, 1, 10, 0, 10), put(g, 1, 20, 10, 20), put(g, 2, 0, 20, 30)
        d = put(k, 1, 15, 0, 10)
        empty = put(g, 3, 0, 5, 5)
    probe = e.read(b_)
    assert e.previous(order, probe).item_id == a and e.next(order, probe).item_id == c
    assert e.next(order, probe, excluded=[c]).item_id == empty and e.previous(order, e.read(a)) is None
    free = probe.copy()
    free.id, free.values["subrank"] = 10**6, 15
    assert e.previous(order, free).item_id == a and e.next(order, free).item_id == b_
    free.values |= {"start": 5, "end": 15}
    assert [r.item_id for r in e.overlapping(span, free)] == [a, b_]
    free.values |= {"start": 10, "end": 20}
    assert [r.item_id for r in e.overlapping(span, free, excluded=[b_])] == []
    free.values |= {"start": 5, "end": 5}
    assert e.overlapping(span, free) == []
    assert [r.item_id for r in e.overlapping(span, e.read(d))] == []
    assert e.query(item.handle, QuerySpec(where(start, "<", 15) & where(end, ">", 5))).count() == 3


def test_a_cascade_over_stored_rows_takes_few_jobs(spark, monkeypatch):
    """Jobs don't grow with the rows that go; lists close up, and the removal is undone and done again."""
    from skein import store

    monkeypatch.setattr(store, "MAX_LISTED", 20)  # both ways to look for ids are taken
    b = SchemaBuilder()
    doc = b.create_table("Doc")
    doc.add_column("name", S)
    doc.add_association("up", doc.handle)
    line = b.create_list("Line")
    line.add_column("text", S)
    line.set_association("doc", doc.handle)
    schema = b.freeze()
    docs = [(1, None, None, "a", None), (2, None, None, "b", None)] + [(i, None, None, f"c{i}", 1 if i % 2 else 2) for i in range(10, 110)]
    lines = [(1000 + i, None, i // 2, f"l{i}", 1 if i % 2 else 2) for i in range(60)]
    frame = lambda c, rows: spark.createDataFrame(rows, schema.info(c.handle).struct)
    e = Engine(spark, schema, {"Doc": frame(doc, docs), "Line": frame(line, lines)}, 5000)
    state = lambda: [sorted(map(tuple, e.frame(h).collect()), key=str) for h in (doc.handle, line.handle)]
    before = state()
    spark.sparkContext.setJobGroup("cascade", "")
    with e.transaction() as t:
        t.remove(1)
        assert len(t.change_set.operations) == 1 + 50 + 30 and len(set(t.change_set.links)) == len(t.change_set.links) == 80
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("cascade")) < 40
    spark.sparkContext.setJobGroup("other", "")
    after = state()
    assert after == [sorted((r for r in docs if r[0] != 1 and r[4] != 1), key=str), sorted((r for r in lines if r[4] != 1), key=str)]
    assert e.undo() and state() == before
    assert e.redo() and state() == after
    assert e.undo() and state() == before
