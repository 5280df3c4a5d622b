"""What workers keep from task to task."""

from eventloom.llm import bpe, common, token_files
from eventloom.llm.registry import default_vocabulary


def test_other_operators_tables_go():
    """A worker that begins another operator's task drops the vocabulary's tables, which would stay beside that one's own memory."""
    with open(default_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    bpe.transducer(spec)
    common.begin("bpe")
    assert bpe._loaded
    common.begin()
    assert not bpe._loaded
    token_files.encoder(spec, 0)
    common.begin("bpe")
    assert not token_files._encoders
