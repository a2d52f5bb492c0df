"""Every turn is parsed back and compared, plain ones too."""

import pytest
from pyspark.sql import functions as F

from splitmill.llm import chat


def test_a_fault_of_the_parser_shows_in_a_plain_turn(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "plain words")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(rows).first().formatted == "### user:\nplain words</turn>\n"
    monkeypatch.setattr(chat, "unescape", lambda text: F.concat(text, F.lit("!")))
    with pytest.raises(Exception, match="round trip"):
        chat.format_conversations(rows).collect()
