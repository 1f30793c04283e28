"""The ten queries of this subpackage and the SQL of those that SQL can express."""

from weftline.llm.bpe import op5_bpe
from weftline.llm.chat import OP6_SQL, op6_chat
from weftline.llm.langid import op2_langid
from weftline.llm.media import op3_audio
from weftline.llm.mixing import OP10_SQL, op10_mixing
from weftline.llm.near_dedup import op9_near_dedup
from weftline.llm.quality_qda import op4_quality
from weftline.llm.quality_rules import op7_rules
from weftline.llm.secrets import op1_secrets
from weftline.llm.urls import OP8_SQL, op8_urls

QUERIES = {
    f.__name__: f
    for f in (op1_secrets, op2_langid, op3_audio, op4_quality, op5_bpe, op6_chat, op7_rules, op8_urls, op9_near_dedup, op10_mixing)
}
ORACLE_SQL = {"op6_chat": OP6_SQL, "op8_urls": OP8_SQL, "op10_mixing": OP10_SQL}
