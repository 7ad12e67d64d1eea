"""Stateless operators on Structured Streaming (validation + batch scoring).

The request-side operators (C9-C12, J7, J14) are row-local expressions and
``model.transform`` calls, so they apply to a streaming DataFrame unchanged;
no state store, watermark or custom stateful operator is needed.  The sink
checkpoint lives under the shared ``spark.checkpoint.dir`` so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators import quality as Q
from cohortlens.session import ensure_checkpoint_dir

REQUEST_SCHEMA = ("aluno_id string, ano int, inde double, ieg double, ida double, ips double, iaa double, "
                  "ian double, inde_anterior double, ieg_anterior double, ida_anterior double, "
                  "anos_no_programa int, tendencia_inde double, pedra string")


def score_requests(requests: DataFrame, risk_model, profile_model=None) -> DataFrame:
    """Validate, then score every request; invalid ones keep their errors.

    Both models are applied as one chain of ``transform`` calls (profile
    first, then risk) -- no join between branches of the input, so the same
    code runs on a batch or a streaming DataFrame.  The cluster-name
    dimension is a k-row static table (stream-static broadcast join).
    """
    from cohortlens.operators import models as ML
    scored = ML.score_requests(Q.validate(requests), risk_model, profile_model)
    profile = ["cluster_id", "cluster_nome"] if profile_model is not None else []
    return scored.select("aluno_id", "ano", "erros", "valido", *profile, "risco_probabilidade", "risco_classe", "vai_cair")


def start_scoring_stream(spark, source_dir: str, sink_dir: str, risk_model, name: str = "risk_scoring",
                         fmt: str = "parquet", trigger_once: bool = True, profile_model=None) -> StreamingQuery:
    """Read request files as they land, score them, append results to ``sink_dir``."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).format(fmt).load(source_dir)
    out = score_requests(stream, risk_model, profile_model)
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt) \
        .outputMode("append")
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="30 seconds")
    return writer.start()
