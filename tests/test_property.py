from hypothesis import given, settings, strategies as st

STMTS = ["x = 1", "y = x + 2", "if x:\n    pass", "if x:\n    pass\nelse:\n    y = 1", "for i in a:\n    pass",
         "return x", "while x:\n    x -= 1", "try:\n    pass\nexcept ValueError:\n    pass", "import os", "z += 3"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(STMTS), min_size=1, max_size=6))
def test_self_diff_only_else_records(diff, body):
    rows = diff("\n".join(body), "\n".join(body))
    assert all(r["rule"] == "R03" for r in rows)
    assert len(rows) == sum(1 for s in body if "else" in s)
