"""The purged AUC covers every series that has folds."""

import os

import pytest

from tidemark.plans import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def test_purged_auc_covers_every_series(spark):
    assets = lambda name: {r.asset for r in QUERIES[name](spark, DATA).select("asset").collect()}
    found = assets("purged_auc")
    assert found == assets("purged_folds") and len(found) > 1
