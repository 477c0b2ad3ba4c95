import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from patchlens.session import get_session
    s = get_session("local[4]", app="patchlens-tests", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="patchlens-test-ckpt-"), "spark.ui.showConsoleProgress": "false"})
    yield s


@pytest.fixture(scope="session")
def diff(spark):
    """diff(old_body, new_body, mode) -> list of change dicts of the single function ``f``."""
    from patchlens.plans.analyze import analyze_corpus

    def indent(body):
        return "\n".join("    " + ln for ln in body.splitlines())

    def run(old_body, new_body, mode="reference", wrap=True):
        old = f"def f(a, b):\n{indent(old_body)}\n" if wrap else old_body
        new = f"def f(a, b):\n{indent(new_body)}\n" if wrap else new_body
        v = spark.createDataFrame([("p", 0, old), ("p", 1, new)], "pair_id string, version int, source string")
        rows = analyze_corpus(v, mode).orderBy("first_ord", "func", "phase", "pos", "seq").collect()
        return [r.asDict() for r in rows]
    return run
