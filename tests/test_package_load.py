"""Packages are loaded whole or not at all; stops and platforms of routes merge."""

import hashlib
import json
import random

import numpy as np
import pytest

from kvartal.operators import assign
from kvartal.sources import package as P


def build(folder, zones=(0, 1, 0), rows=3):
    folder.mkdir(exist_ok=True)
    tables = {
        "stops": ({"zone": "u32"}, P.encode("stops", 1, "p", "1", {"zone": ("u32", np.array(zones, dtype=np.uint32))}, len(zones))),
        "zones": ({"size": "u32"}, P.encode("zones", 1, "p", "1", {"size": ("u32", np.array([5, 6], dtype=np.uint32))}, 2)),
    }
    index = {"package": "p", "tables": []}
    for name, (columns, data) in tables.items():
        (folder / f"{name}.mtab").write_bytes(data)
        index["tables"].append({"name": name, "path": f"{name}.mtab", "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "rows": 2 if name == "zones" else rows, "columns": columns})
    (folder / "index.json").write_text(json.dumps(index))
    (folder / "manifest.json").write_text(json.dumps({"package_id": "p", "index": "index.json"}))
    return str(folder)


def rules(r, t):
    return r.ref("stop_zone", t["stops"], "zone", t["zones"], "row").unique("zone_size", t["zones"], ["size"])


def test_load(spark, tmp_path):
    got = P.load_package(spark, build(tmp_path / "good"), rules)
    assert [r.zone for r in got["stops"].orderBy("row").collect()] == [0, 1, 0] and got["zones"].count() == 2


def test_faults_are_named_and_nothing_is_loaded(spark, tmp_path):
    with pytest.raises(P.PackageError, match="stop_zone: 1"):
        P.load_package(spark, build(tmp_path / "lost", (0, 7, 1)), rules)
    with pytest.raises(P.PackageError, match="stops: 4 rows: 1"):
        P.load_package(spark, build(tmp_path / "rows", rows=4), rules)
    at = tmp_path / "hash"
    build(at)
    raw = bytearray((at / "stops.mtab").read_bytes())
    raw[-1] ^= 1
    (at / "stops.mtab").write_bytes(raw)
    (at / "zones.mtab").unlink()
    with pytest.raises(P.PackageError, match="stops.mtab: hash; zones.mtab: missing"):
        P.load_package(spark, str(at), rules)
    (at / "index.json").write_text('{"package": "q", "tables": [{"name": "a", "path": "../a"}, {"name": "a", "path": "b"}]}')
    with pytest.raises(P.PackageError, match="listed twice.*outside.*another package"):
        P.load_package(spark, str(at))


def test_pool_and_document(spark, tmp_path):
    data = P.encode("f", 1, "p", "1", {"at": ("u32", np.array([0, 2, 2, 5], dtype=np.uint32)), "b": ("u32", np.array([9, 8, 7, 6, 5], dtype=np.uint32))}, 3)
    (tmp_path / "f.mtab").write_bytes(data)
    got = sorted(map(tuple, P.read_pool(spark, str(tmp_path / "f.mtab"), "at", "b").collect()))
    assert got == [(0, 0, 9), (0, 1, 8), (2, 0, 7), (2, 1, 6), (2, 2, 5)]
    for k in (1, 2):
        P.write_document(spark, str(tmp_path / "x.json"), {"b": k, "a": [1, 2]})
        assert P.document(spark, str(tmp_path / "x.json")) == {"a": [1, 2], "b": k}
    assert [f.name for f in tmp_path.glob("x.json*")] == ["x.json"]


def walk(members, near, same):
    """The same for one route, member by member."""
    close = lambda a, b: (d := ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5) < near or a[4] == b[4] != "" and d < same
    turns = sum(a[0] != b[0] for a, b in zip(members, members[1:]))
    out, i = [], 0
    if turns == 1:
        cut = next(k for k in range(1, len(members)) if members[k][0] != members[0][0])
        groups = {members[0][0]: members[:cut], members[cut][0]: members[cut:]}
        base = max(("stop", "platform"), key=lambda k: (len(groups[k]), k == "stop"))
        rest = groups["platform" if base == "stop" else "stop"]
        slots = [[None, []] for _ in range(len(groups[base]) + 1)]
        at = 0
        for m in rest:
            for k in range(at, len(groups[base])):
                if close(groups[base][k], m):
                    at = k + 1
                    slots[at][0] = m[1]
                    break
            else:
                slots[at][1].append((m[1], None))
        if any(s[0] for s in slots):
            for k, s in enumerate(slots):
                out += ([(groups[base][k - 1][1], s[0])] if k else []) + s[1]
            return out
    while i < len(members):
        a, b = members[i], members[i + 1] if i + 1 < len(members) else None
        if turns != 1 and b and a[0] != b[0] and close(a, b):
            out.append((a[1], b[1]) if a[0] == "stop" else (b[1], a[1]))
            i += 2
        else:
            out.append((a[1], None))
            i += 1
    return out


def test_merge_stops(spark):
    rng = random.Random(8)
    routes = {}
    for r in range(120):
        kinds = [rng.choice(["stop", "platform"]) for _ in range(rng.randint(1, 9))]
        kinds = sorted(kinds, reverse=rng.random() < 0.5) if r % 3 == 0 else kinds
        routes[r] = [(k, 1 + r * 100 + n, rng.randrange(40), rng.randrange(40), rng.choice(["", "a", "b"])) for n, k in enumerate(kinds)]
    rows = [(r, n, *m) for r, ms in routes.items() for n, m in enumerate(ms)] + [(0, 99, "other", 5, 0, 0, "")]
    got = assign.merge_stops(spark.createDataFrame(rows, "route long, no int, kind string, id long, x long, y long, name string"), 12, 30).collect()
    by = {}
    for g in sorted(got, key=lambda g: (g.route, g.place)):
        by.setdefault(g.route, []).append((g.id, g.alias))
    assert by == {r: walk(ms, 12, 30) for r, ms in routes.items()}
