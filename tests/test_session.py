"""Where intermediate tables go."""

import pytest

from flowsight.session import scratch_dir


class Session:
    def __init__(self, master, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = type("Context", (), {"master": master})()


def test_scratch_is_shared():
    given = scratch_dir(Session("spark://a:7077", spark_checkpoint_dir="hdfs://x/y/"), "t")
    assert given.startswith("hdfs://x/y/t-")
    assert scratch_dir(Session("local[2]", spark_sql_warehouse_dir="file:/w"), "t").startswith("file:/w/t-")
    assert scratch_dir(Session("yarn", spark_sql_warehouse_dir="s3a://w"), "t").startswith("s3a://w/t-")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(Session("yarn", spark_sql_warehouse_dir="file:/w"), "t")
