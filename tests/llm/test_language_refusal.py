"""Documents of languages that were not learned are refused."""

import pytest
from larkspan.llm import language_id
from larkspan.llm import queries as q
from pyspark.sql import functions as F


@pytest.mark.parametrize("learned", [("en", "fr", "es"), ("de", "en", "fr"), ("de", "en"), ("es", "fr"), ("en",)])
def test_language_not_learned_is_refused(documents, learned):
    known = documents.where(F.col("text").rlike(r"\p{L}"))
    model = language_id.train(known.where(F.col("lang").isin(*learned) & (q.remainder(4) != 2)))
    assert model.labels == tuple(sorted(learned)) and model.least > (1 / len(learned) if len(learned) > 1 else 0)
    found = language_id.identify(known, model).join(documents, "doc_id").toPandas()
    mine = found.lang.isin(learned)
    assert found.accepted[mine].mean() > 0.95 and found.accepted[~mine].mean() < 0.05
