"""Limits, formats and texts that decide results."""

# --- limits -------------------------------------------------------------
MAX_DOCUMENT_BYTES = 100 * 1024 * 1024
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
CONTEXT_CHUNK_CHARS = 1000
CONTEXT_TOP_K = 5
CANDIDATE_TOP_K = 30
MIN_RETRIEVAL_SCORE = 0.0
STREAM_IDLE_SECONDS = 3600
STREAM_DELTA_CHARS = 20
SNIPPET_CHARS = 180
CITATION_SNIPPET_CHARS = 300
CITATION_PREVIEW_CHARS = 200
METRICS_WINDOW_SECONDS = 300
METRICS_MAX_ROWS = 5000
RATE_WINDOW_SECONDS = 60
RATE_IP_LIMIT = 120
RATE_USER_LIMIT = 60
HISTORY_FETCH = 10
HISTORY_ROUNDS = 3
PREVIEW_MESSAGE_CHARS = 300
PREVIEW_TOTAL_CHARS = 4000
GAUGE_POINTS = 18
EMBEDDING_BATCH = 32
RERANK_BATCH = 16

# --- document types -----------------------------------------------------
SUPPORTED_EXTENSIONS = ("md", "txt", "json", "csv", "pdf", "docx")
MIME_BY_EXTENSION = {
    "md": "text/markdown",
    "txt": "text/plain",
    "json": "application/json",
    "csv": "text/csv",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
MIME_DEFAULT = "application/octet-stream"
EMPTY_FILE_NAME = "upload.bin"
TEXT_ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk")

# --- states -------------------------------------------------------------
RUNNING_STATES = ("STARTED", "PROGRESS")
FAILED_STATES = ("FAILURE", "FAILED")
TERMINAL_STATES = ("SUCCESS", "FAILURE", "FAILED")
PROCESSING_DOCUMENT_STATES = ("PROCESSING", "UPLOADED")
MESSAGE_ROLES = ("user", "assistant", "system")
MESSAGE_STATUSES = ("PENDING", "PROCESSING", "SUCCESS", "FAILURE")
TONE_OK = ("OK", "SUCCESS", "READY", "HEALTHY")
TONE_ERROR = ("FAILURE", "FAILED", "ERROR", "UNHEALTHY")
TONE_WARN = ("STARTED", "PROGRESS", "PROCESSING", "PENDING", "UPLOADED")

# --- progress per task type and stage ------------------------------------
STAGE_PROGRESS = {
    "ingest_document": {
        "document_marked_ingesting": 5,
        "document_loaded": 20,
        "document_chunked": 40,
        "chunks_inserted": 60,
        "embedding_chunks": 75,
        "building_faiss_index": 90,
        "finished": 100,
        "failed": 100,
    },
    "chat_generate": {
        "load_user_message": 10,
        "retrieve": 30,
        "generate_answer": 60,
        "save_assistant_message": 80,
        "finished": 100,
        "failed": 100,
    },
    "ping": {"started": 0},
}
INGEST_TIMINGS = ("text_extract_ms", "chunking_ms", "chunk_insert_ms", "embedding_ms", "index_ms")

# --- prompt and answer texts --------------------------------------------
SYSTEM_INSTRUCTION = (
    "你是一个RAG问答助手。\n"
    "请严格基于提供的检索内容回答问题。\n"
    "如果答案无法从检索内容中得到，请明确说明："
    "“根据当前检索内容无法确定”。\n"
    "不要编造未在检索内容中出现的事实。\n"
    "回答要简洁、准确、有条理。\n"
    "当检索内容中存在多个片段时，请优先整合共同信息。"
)
NORMAL_PROMPT = (
    "已检索内容：\n\n%s\n\n用户问题：\n%s\n\n"
    "请严格依据检索内容回答。如果无法从检索内容中确定答案，请明确说明无法确定。"
)
LOW_CONFIDENCE_PROMPT = (
    "已检索内容（注意：以下片段与问题的相关性或置信度偏低，仅可作为弱参考）：\n\n%s\n\n用户问题：\n%s\n\n"
    "请严格遵守以下要求：\n"
    "1. 只能基于检索内容回答，不要补充外部知识，不要猜测。\n"
    "2. 如果检索内容不能直接支持答案，请明确回答：根据当前检索内容无法确定。\n"
    "3. 如果检索内容仅提供了部分线索，请用保守措辞回答，例如“从当前片段来看”或“现有片段仅显示”。\n"
    "4. 不要把不确定的信息表述成确定事实。"
)
NO_CONTEXT_PROMPT = (
    "当前没有检索到可用文档片段。\n\n用户问题：\n%s\n\n"
    "请不要编造答案，请明确说明根据当前检索内容无法确定。"
)
HISTORY_RETRIEVAL_HEADER = "已检索内容：\n\n"
NO_CONTEXT_ANSWER = "根据当前检索内容无法确定该问题的答案，因为没有检索到可用文档片段。"
TEMPLATE_ANSWER_EMPTY = "我没有在当前文档中检索到与问题“%s”高度相关的内容。你可以尝试换一个更具体的问法。"
TEMPLATE_ANSWER_HEAD = "针对你的问题“%s”，我从文档中检索到了以下相关内容："
TEMPLATE_ANSWER_TAIL = "以上是基于当前文档检索结果生成的 mock answer，下一步可以接入真实 LLM 总结这些片段。"
FALLBACK_ANSWER_EMPTY = "根据当前检索内容无法确定该问题的答案。当前没有检索到可直接支持回答的文档片段。"
FALLBACK_ANSWER_HEAD = "基于当前检索到的文档内容，给出如下简要回答："
FALLBACK_ANSWER_QUESTION = "问题：%s"
FALLBACK_ANSWER_LIST = "参考片段摘要："
FALLBACK_ANSWER_TAIL = "说明：当前回答来自 mock fallback，用于在 LLM 不可用时保证链路可用。"
