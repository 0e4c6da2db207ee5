"""Row types of the fixed records."""

from __future__ import annotations

SCRIPTS = (
    "Id BIGINT, AuthorUserId BIGINT, ScriptProjectId BIGINT, ForkParentScriptVersionId BIGINT, "
    "CurrentScriptVersionId BIGINT, TotalVotes INT"
)
SCRIPT_VERSIONS = "Id BIGINT, ScriptLanguageId INT, ScriptContent STRING"
SCRIPT_LANGUAGES = "Id INT, Name STRING"
CRAWLED = "link STRING, user STRING, votes INT, language STRING, code STRING"
PAGES = "url STRING, html STRING"
CORPUS = "user_id BIGINT, project_id BIGINT, parent_id BIGINT, script_id BIGINT, script STRING"
STATIC_CALLS = (
    "cell INT, seq INT, func_text STRING, module STRING, name STRING, qualname STRING, err STRING"
)
RAW_EVENTS = (
    "script STRING, seq BIGINT, kind STRING, static_instr_id INT, loop_id INT, "
    "func_module STRING, func_name STRING, caller_type_module STRING, caller_type_name STRING, "
    "value_ids ARRAY<BIGINT>, lhs_ids ARRAY<BIGINT>"
)
CALL_EVENTS = (
    "script STRING, project INT, call_id BIGINT, static_instr_id INT, static_loop_id INT, "
    "caller_type_module STRING, caller_type_name STRING, func_module STRING, func_name STRING, "
    "dependencies ARRAY<BIGINT>, args ARRAY<MAP<STRING,STRING>>, src_code STRING"
)
META_FEATURES = "entity STRING, feature STRING, num DOUBLE, str STRING"
CANDIDATES = (
    "cand_id BIGINT, steps ARRAY<STRUCT<role: STRING, component: STRING, wrap: BOOLEAN, "
    "log_prob: DOUBLE>>, log_prob DOUBLE, depth INT, score DOUBLE"
)
PREDICTIONS = "program INT, row_id BIGINT, pred INT, proba ARRAY<DOUBLE>"
STATUS_LOG = "line_no BIGINT, script_id BIGINT, status INT"
TIMES = "script STRING, time DOUBLE"
SEARCH_LOG = (
    "seq INT, role STRING, component STRING, wrap BOOLEAN, started DOUBLE, seconds DOUBLE, "
    "success BOOLEAN"
)
