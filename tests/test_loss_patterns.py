import __spark_entry__ as entry
from acacia.operators import components
from tests.conftest import SMALL


def test_loss_patterns_label_blocks(spark, monkeypatch):
    groups, label = [], components.pixel_components
    monkeypatch.setattr(components, "pixel_components", lambda pixels, by, corners=False: groups.append(by) or label(pixels, by, corners))
    assert entry.queries()["loss_patterns"](spark, SMALL).count() > 0
    assert groups == [["park_id", "tile", "year", "block_r", "block_c"]]
