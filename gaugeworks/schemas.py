"""DDL of the tables that pass between the stages."""

TURN = "STRUCT<role: STRING, content: STRING>"
CONVO = f"ARRAY<{TURN}>"

CONVERSATION = f"dset_name STRING, local_idx BIGINT, convo {CONVO}"
DATASET_RANGE = "dset_name STRING, start BIGINT, stop BIGINT"
EMBEDDING = "instance_idx BIGINT, embedding ARRAY<FLOAT>"
TASK_DWA = "title STRING, task STRING, dwa_id STRING, dwa_title STRING"
DWA_IWA = "dwa_id STRING, dwa_title STRING, iwa_title STRING"
RESPONSE = (
    "request_hash STRING, attempt INT, model STRING, output STRING, error STRING, "
    "total_tokens BIGINT, prompt_tokens BIGINT, completion_tokens BIGINT, reasoning_tokens BIGINT"
)
PREDICTION = (
    "idx BIGINT, convo_hash STRING, request_hash STRING, response STRING, error STRING"
)
QUESTION = f"uid STRING, category STRING, subcategory STRING, convo {CONVO}"
# one of `prompt` (single turn) and `convo` (multi turn) is filled
QUESTION_ANY = f"uid STRING, category STRING, subcategory STRING, prompt STRING, convo {CONVO}"
ANSWER = (
    f"uid STRING, ans_id STRING, model STRING, messages {CONVO}, "
    "tstamp DOUBLE, metadata MAP<STRING, STRING>"
)
GAME = f"STRUCT<score: STRING, judgment: STRUCT<answer: STRING>, prompt: {CONVO}>"
JUDGMENT = (
    "uid STRING, category STRING, judge STRING, model STRING, baseline STRING, "
    f"games ARRAY<{GAME}>"
)
LOGPROBS = (
    "ARRAY<STRUCT<token: STRING, bytes: ARRAY<INT>, logprob: DOUBLE, "
    "top: ARRAY<STRUCT<token: STRING, bytes: ARRAY<INT>, logprob: DOUBLE>>>>"
)

# fixed values: the categories of a moderation result
MODERATION_CATEGORIES = (
    "harassment",
    "harassment_threatening",
    "hate",
    "hate_threatening",
    "self_harm",
    "self_harm_instructions",
    "self_harm_intent",
    "sexual",
    "sexual_minors",
    "violence",
    "violence_graphic",
)
MODERATION_FIELDS = (
    "flagged BOOLEAN, categories STRUCT<"
    + ", ".join(f"{c}: BOOLEAN" for c in MODERATION_CATEGORIES)
    + ">, category_scores STRUCT<"
    + ", ".join(f"{c}: DOUBLE" for c in MODERATION_CATEGORIES)
    + ">"
)
