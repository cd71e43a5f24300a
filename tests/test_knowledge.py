from __future__ import annotations

import pytest

from loomdex.knowledge import KnowledgeBase


def test_interface(spark, sf, tmp_path):
    kb = KnowledgeBase.load(spark, sf)
    plain = [(r.id, round(r.score, 9), r.snippet) for r in kb.search("mempool", limit=50).collect()]
    kb.build_index(f"file://{tmp_path}/index")
    assert [(r.id, round(r.score, 9), r.snippet) for r in kb.search("mempool", limit=50).collect()] == plain
    one = plain[0][0]
    assert kb.document("/" + one).first().id == one and kb.document("nothing").count() == 0
    assert kb.references("BIP-412", limit=5).count() <= 5
    assert kb.timeline("no such concept").count() == 0
    assert kb.health().first().total == kb.documents.count() and kb.stats().count() > 3
    assert kb.changes(3, 5).count() == 5 and kb.sync_states("nothing").count() == 0
    assert kb.find_commit("mempool").count() <= 10
    assert kb.to_enrich("commit").columns == ["id", "body", "source_repo"]
    with pytest.raises(ValueError):
        kb.spec("nope", 1)
