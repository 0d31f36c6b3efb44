import os

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=()):
        schema = "doc_id long, text string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame([(d, t, None if d is None or d % 7 == 0 else f"src{d % 3}", len(t or ""), *["?"] * len(extra)) for d, t in rows], schema)
    return make


SF_SMALL = os.environ.get("QUILL_SF_SMALL", "/root/testdata/sf0.001")
