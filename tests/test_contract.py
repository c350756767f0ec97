"""Driver-side contracts and helpers."""

from __future__ import annotations

import pytest

from feedlens.functions.text import history_windows
from feedlens.operators.contract import Contract, SnapshotError, SourceScope, check_page, distinct


def test_scope_kinds():
    assert SourceScope(" f ").kind == "feed"
    assert SourceScope(tracked_all=True).kind == "tracked_all"
    assert SourceScope(group="vendors", tracked_all=True).kind == "group"
    assert SourceScope(group=" ").kind == "global"


def test_contract_and_retrieval():
    assert Contract(profile_id="p", search="x").retrieval == "complete"
    assert Contract(search=" x ").retrieval == "progressive"
    assert Contract(search="  ").retrieval == "bounded"
    a, b = Contract(interests=(("g", ("x", "y", "x")),)), Contract(interests=(("g", ("y", " x")), (" ", ("z",))))
    assert a.scope_key() == b.scope_key() != a.scope_key(True)
    assert distinct([" a", "", "a", "b"]) == ("a", "b") and Contract(profile_version=0).profile_version == 1


def test_snapshot_pages():
    check_page("k", "k", 0, 59, 1)
    for code, args in (("scope_mismatch", ("k", "j", 0, 1, 1)), ("expired", ("k", "k", 0, 61, 1)), ("invalid_page", ("k", "k", 0, 1, 0))):
        with pytest.raises(SnapshotError) as e:
            check_page(*args)
        assert e.value.code == code


def test_windows_cover_without_overlap():
    found = history_windows("2024-01-01", "2024-12-31", 90)
    assert found[0] == ("2024-01-01", "2024-03-30") and found[-1][1] == "2024-12-31" and len(found) == 5
