"""The queries opN_<name> of this subpackage, and their oracles in DuckDB's SQL where there are any."""

from talweg.llm.bpe import op2_bpe
from talweg.llm.decontaminate import op6_decontaminate
from talweg.llm.decontaminate import oracle as decontaminate_oracle
from talweg.llm.licenses import op3_licenses
from talweg.llm.linededup import op11_lines
from talweg.llm.linededup import oracle as lines_oracle
from talweg.llm.media import op7_media
from talweg.llm.merkle import op13_manifest
from talweg.llm.merkle import oracle as manifest_oracle
from talweg.llm.neardup import op1_neardup
from talweg.llm.quality import op5_quality
from talweg.llm.repair import op12_repair
from talweg.llm.secrets import op4_secrets
from talweg.llm.tokenfiles import op8_tokenfiles
from talweg.llm.toxicity import op9_toxicity
from talweg.llm.urls import op10_urls
from talweg.llm.urls import oracle as urls_oracle

QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_bpe": op2_bpe,
    "op3_licenses": op3_licenses,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_media": op7_media,
    "op8_tokenfiles": op8_tokenfiles,
    "op9_toxicity": op9_toxicity,
    "op10_urls": op10_urls,
    "op11_lines": op11_lines,
    "op12_repair": op12_repair,
    "op13_manifest": op13_manifest,
}
ORACLES: dict[str, str] = {"op6_decontaminate": decontaminate_oracle(), "op10_urls": urls_oracle(), "op11_lines": lines_oracle(), "op13_manifest": manifest_oracle()}
