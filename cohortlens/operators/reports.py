"""Report dataset (survey N10, C8, C13, C14): one prompt per entity.

The remote text generation is out of scope; this builds the table a
generation job would consume -- model outputs joined to the latest record,
defaults applied, and the prompt rendered by a native ``concat``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlens.functions.scalars import trend_label
from cohortlens.functions.text import render_template
from cohortlens.operators.cleaning import report_defaults

# The data block of the student report prompt (placeholders
# and labels as the report expects them).
REPORT_TEMPLATE = (
    "ALUNO: {nome}\n"
    "IDADE: {idade} anos\n"
    "PEDRA ATUAL: {pedra} (INDE: {inde:.1f})\n"
    "\n"
    "HISTÓRICO:\n"
    "- Anos no programa: {anos_no_programa}\n"
    "- Tendência do INDE: {tendencia_inde}\n"
    "- Perfil (Cluster): {cluster_nome}\n"
    "- Risco de queda no próximo ano: {risco_percentual}%\n"
    "\n"
    "FEEDBACKS ANTERIORES:\n"
    "{feedback_texto}\n"
)

# The data block of the report prompt with all indicators and both models' results (17 fields).
FULL_TEMPLATE = (
    "DADOS DO ALUNO:\n"
    "- Nome: {nome}\n"
    "- Idade: {idade} anos\n"
    "- Pedra Atual: {pedra} (INDE: {inde:.1f})\n"
    "\n"
    "INDICADORES EDUCACIONAIS:\n"
    "- IEG (Engajamento): {ieg:.1f}\n"
    "- IDA (Desempenho Acadêmico): {ida:.1f}\n"
    "- IPS (Psicossocial): {ips:.1f}\n"
    "- IAA (Autoavaliação): {iaa:.1f}\n"
    "- IAN (Adequação ao Nível): {ian:.1f}\n"
    "- IPV (Ponto de Virada): {ipv:.1f}\n"
    "- IPP (Psicopedagógico): {ipp:.1f}\n"
    "\n"
    "RESULTADOS DOS MODELOS PREDITIVOS (Machine Learning):\n"
    "- Predição de Risco de Queda: {risco_classe} ({risco_percentual}%)\n"
    "- Cluster (Perfil Comportamental): {cluster_nome}\n"
    "\n"
    "HISTÓRICO:\n"
    "- Anos no programa: {anos_no_programa}\n"
    "- Tendência do INDE: {tendencia_inde}\n"
    "\n"
    "FEEDBACKS ANTERIORES:\n"
    "{feedback_texto}\n"
)


def report_rows(latest: DataFrame) -> DataFrame:
    """C8 + C13: trend label from the numeric slope, then field defaults.

    ``latest`` carries lower-case report fields (nome, pedra, inde, ieg, ...,
    tendencia_num, cluster_nome, risco_percentual, risco_classe)."""
    df = latest
    if "tendencia_num" in df.columns:
        df = df.withColumn("tendencia_inde", trend_label("tendencia_num"))
    return report_defaults(df)


def render_prompts(rows: DataFrame, template: str = REPORT_TEMPLATE, out: str = "prompt") -> DataFrame:
    """C14: the rendered prompt per row."""
    return rows.withColumn(out, render_template(template))
