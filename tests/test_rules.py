"""Rules in batches against one change at a time, simulated without Spark on random type graphs."""

import random

from graphloom.functions import trees as T
from graphloom.operators import optimize
from test_types import SCHEMA, U64, FIELDS, b, m, ptr, row, types  # noqa: F401

NAMED = T.FIRST_PRIM


def single(t):
    return t[0][1] if len(t) == 1 and t[0][0] == "BASE" else None


def put(t, goff, by):
    out = []
    for x in t:
        if x[1] != goff:
            out.append(x)
        elif x[0] == "BASE":
            out += by
        elif single(by) is not None:
            out.append((x[0], by[0][1], x[2], by[0][3]))
        else:
            raise ValueError("class")
    return out


class Sequential:
    """types: goff -> [kind, size, member trees, vtable, {(name, targ trees)}]."""

    def __init__(self, types, symbols):
        self.types, self.symbols, self.edges = types, symbols, set()
        every = [t for r in types.values() for t in [*r[2], *[a for n in r[4] for a in n[1]]]]
        self.fixed = {x[1] for t in [*every, *symbols] for x in t if x[0] in ("PTMD", "PTMF")}
        self.fixed |= {g for g, r in types.items() if r[3] or any(x[1] == g for t in [*r[2], *[a for n in r[4] for a in n[1]]] for x in t)}

    def size(self, t):
        op, g, n, _ = t[-1]
        return 8 if op != "BASE" else 8 if g == U64 else self.types[g][1]

    def change(self, rule):
        for g in sorted(self.types):
            kind, size, ms, vt, _ = self.types[g]
            to = None
            if rule == 0 and kind == "struct" and len(ms) == 1 and not vt and self.size(ms[0]) == size:
                to = ms[0]
            if rule == 1 and kind == "union" and len(ms) == 0 and size == 1:
                self.types[g][0] = "struct"
                return True
            if rule == 1 and kind == "union" and len(ms) == 1:
                to = ms[0]
            if rule == 1 and kind == "union" and len(ms) == 2:
                named = [single(t) is not None and single(t) < NAMED for t in ms]
                to = next((t for t, n in zip(ms, named) if n and sum(named) == 1 and self.size(t) == size), None)
            if rule == 2 and kind == "union" and ms and all(t == ms[0] for t in ms):
                to = ms[0]
            if to is None or (single(to) is None and g in self.fixed):
                continue
            if any(x[1] == g for x in to):
                raise ValueError("holds itself")
            self.eliminate(g, to)
            return True
        return False

    def names(self, names, g, to):
        kept = {(n, a) for n, a in names if single(to) is not None or not any(x[1] == g for t in a for x in t)}
        return {(n, tuple(tuple(put(t, g, to)) for t in a)) for n, a in kept}

    def eliminate(self, g, to):
        given = self.names(self.types.pop(g)[4], g, to)
        for r in self.types.values():
            r[2], r[4] = [put(t, g, to) for t in r[2]], self.names(r[4], g, to)
        self.symbols = [put(t, g, to) for t in self.symbols]
        if single(to) is not None and single(to) < NAMED:
            base = self.types[single(to)][4]
            self.edges |= {(d[0], x[0]) for d in given for x in base}
            base |= given

    def run(self):
        while any(self.change(rule) for rule in range(3)):
            pass
        return self


def graph(rng, at):
    """A few types in an order that goffs don't follow, each built from those before it."""
    goffs = rng.sample(range(at, at + 40), 9)
    made, rows_, wide = {}, [], []

    def tree(eight):
        pick = rng.random()
        below = [g for g in goffs if g in made and (made[g] == 8 or not eight)]
        if pick < 0.55 and below:
            return b(rng.choice(below))
        if pick < 0.7:
            return b(U64)
        if pick < 0.8 and made:
            return [*b(U64), ("PTMD", rng.choice(list(made)), None, None)]
        return ptr(b(rng.choice([*made, *wide, U64])))

    for g in goffs:
        kind = rng.choice(["struct", "union"])
        if kind == "struct":
            n = rng.choice([1, 1, 1, 2])
            ms = [tree(True) for _ in range(n)] + ([ptr(b(g))] if rng.random() < 0.05 else [])
            size = 8 * len(ms) if rng.random() < 0.95 else 24
        else:
            ms = [tree(rng.random() < 0.97) for _ in range(rng.choice([0, 1, 1, 2, 2, 2, 3]))]
            if ms and rng.random() < 0.3:
                ms = [ms[0]] * len(ms)
            size = 8 if ms else 1
        made[g] = size
        if size != 8:
            wide.append(g)
        targs = [t for t in [tree(False)] if rng.random() < 0.3]
        rows_.append((g, kind, size, ms, kind == "struct" and rng.random() < 0.05, targs))
    return rows_, [tree(False) for _ in range(2)]


def state(rows_):
    return {g: [k, s, list(ms), vt, {(f"n{g}", tuple(map(tuple, targs)))}] for g, k, s, ms, vt, targs in rows_}


def test_batches_are_the_same_as_one_by_one(spark):
    rng, given, symbols, want, signs, edges, changed = random.Random(5), [], [], {}, [], set(), 0
    for i in range(60):
        rows_, sym = graph(rng, 100 * i + 1)
        try:
            done = Sequential(state(rows_), sym).run()
        except ValueError:
            continue  # holds itself, or a class would become a tree: an error either way
        changed += len(rows_) - len(done.types)
        given, symbols, signs, edges = given + rows_, symbols + sym, signs + done.symbols, edges | done.edges
        want |= done.types
    assert changed > 80
    df = types(spark, *[row(g, k, name=f"n{g}", byte_size=s, members=[m(0, None, t) for t in ms], vtable=[(0, "f", [b(U64)])] * vt, targs=[("Type", None, t) for t in targs]) for g, k, s, ms, vt, targs in given])
    sym = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(symbols)], f"link_name string, ty {T.TYPE}")
    out = optimize.optimize(optimize.Stage(optimize.from_units(df), sym), optimize.Rules(strict=False))
    plain = lambda t: [tuple(x) for x in t]
    got = {r.goff: [r.kind, r.byte_size, [plain(x.ty) for x in r.members], bool(r.vtable), {(n.name, tuple(tuple(plain(a.tree)) for a in n.targs)) for n in r.fqnames}] for r in out.types.collect()}
    want = {g: [r[0], r[1], [plain(t) for t in r[2]], r[3], r[4]] for g, r in want.items()}
    assert {g: (got.get(g), want.get(g)) for g in got | want if got.get(g) != want.get(g)} == {}
    assert [plain(r.ty) for r in out.symbols.orderBy(out.symbols.link_name.substr(2, 9).cast("int")).collect()] == [plain(t) for t in signs]
    import json

    derived = {(json.loads(r.derived)["name"], json.loads(r.base)["name"]) for r in out.derived.collect()}
    assert derived and derived <= edges


def test_long_chain_in_few_rounds(spark):
    n, calls = 10_000, []
    df = spark.range(n).selectExpr("id as goff", f"case when id = {n - 1} then 'enum' else 'struct' end as kind")
    member = f"array(named_struct('offset', 0L, 'name', 'x', 'ty', array(named_struct('op', 'BASE', 'g', id + 1, 'n', cast(null as int), 's', cast(null as string))), 'special', cast(null as string), 'bit_bytes', cast(null as bigint)))"
    st = types(spark).drop("goff", "kind").schema
    cols = {f.name: f.dataType.simpleString() for f in st.fields}
    put_ = {"name": "concat('c', id)", "byte_size": "8L", "members": f"case when id < {n - 1} then {member} end"}
    df = spark.range(n).selectExpr("id as goff", f"case when id = {n - 1} then 'enum' else 'struct' end as kind", *[f"cast({put_.get(c, 'null')} as {t}) as {c}" for c, t in cols.items()])
    df = df.na.fill({"cu": 0}).selectExpr("goff", "kind", "cu", *[f"coalesce({c}, array()) as {c}" if t.startswith("array") and c != "tree" else c for c, t in cols.items() if c != "cu"])
    sym = spark.createDataFrame([("s", ptr(b(0)))], f"link_name string, ty {T.TYPE}")
    real, optimize.together = optimize.together, lambda *a: calls.append(1) or real(*a)
    try:
        out = optimize.optimize(optimize.Stage(optimize.from_units(df), sym), optimize.Rules())
    finally:
        optimize.together = real
    r = out.types.collect()
    assert len(calls) == 1 and [x.goff for x in r] == [n - 1] and len(r[0].fqnames) == n
    assert [tuple(x) for x in out.symbols.first().ty] == ptr(b(n - 1)) and out.derived.count() == n - 1


def test_types_are_written_once_however_many_batches(spark, monkeypatch):
    """Batches write only what the rules look at: a struct, a union and a union of same types go in three batches, and names follow through all."""
    written, real = [], optimize.cut
    monkeypatch.setattr(optimize, "cut", lambda df: written.append(set(df.columns)) or real(df))
    args = [("Type", None, b(2))]
    df = types(
        spark,
        row(1, "struct", name="A", byte_size=8, members=[m(0, "x", b(2))]),
        row(2, "union", name="B", byte_size=8, members=[m(0, "x", b(3)), m(0, "y", ptr(b(1)))]),
        row(3, "union", name="C", byte_size=8, members=[m(0, "x", b(4)), m(0, "y", b(4)), m(0, "z", b(4))]),
        row(4, "struct", name="D", byte_size=8, members=[m(0, "x", ptr(b(1))), m(4, "y", b(U64))]),
        row(5, "struct", name="E", byte_size=16, members=[m(0, "x", b(1)), m(8, "y", ptr(b(2)))], targs=args),
    )
    sym = spark.createDataFrame([("s", ptr(b(1)))], f"link_name string, ty {T.TYPE}")
    calls, together = [], optimize.together
    monkeypatch.setattr(optimize, "together", lambda *a: calls.append(1) or together(*a))
    out = optimize.optimize(optimize.Stage(optimize.from_units(df), sym), optimize.Rules())
    got = {r.goff: r for r in out.types.collect()}
    plain = lambda t: [tuple(x) for x in t]
    assert len(calls) == 3 and set(got) == {4, 5}
    assert [plain(x.ty) for x in got[5].members] == [b(4), ptr(b(4))] and [plain(x.ty) for x in got[4].members] == [ptr(b(4)), b(U64)]
    assert {n.name for n in got[4].fqnames} == {"A", "B", "C", "D"} and [plain(a.tree) for n in got[5].fqnames for a in n.targs] == [b(4)]
    assert plain(out.symbols.first().ty) == ptr(b(4))
    import json

    assert {(json.loads(r.derived)["name"], json.loads(r.base)["name"]) for r in out.derived.collect()} == {("A", "B"), ("A", "C"), ("B", "C"), ("A", "D"), ("B", "D"), ("C", "D")}
    assert sum("members" in c and "enumerators" in c for c in written) == 1
