"""Every operator of the subpackage has its query in the entry."""

import __spark_entry__ as entry


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for number in range(1, 14):
        assert any(name.startswith(f"op{number}_") for name in names), number
    without = {"op2_language_id", "op6_packing", "op12_byte_network"}
    assert {name for name in names if name.startswith("op")} - set(entry.oracle_sql()) == without
