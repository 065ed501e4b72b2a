"""Schemas of the tables that pass between the parts of the engine."""

from __future__ import annotations

#: A session's events in order. ``input`` is the JSON of a tool call; ``text`` that of a message or result.
EVENTS = (
    "runtime string, session_id string, path string, pos long, kind string, turn int, id string, name string, input string, "
    "text string, final boolean, model string, tool_use_id string, tool_name string"
)
SESSIONS = "runtime string, session_id string, path string, repo string, cwd string, started string, ended string, n_events long"
#: One row per session: counts by detector, compliance by detector, errors.
ROWS = (
    "schema_version int, session_id string, repo string, runtime string, started string, ended string, stances map<string,string>, rules map<string,long>, "
    "compliance map<string,struct<opportunities:long,followed:long,undecided:long>>, rules_errors array<struct<detector:string,error:string>>"
)
#: Kinds of events.
KINDS = ("tool_use", "tool_result", "assistant_text", "user_prompt", "compact")
#: Result texts are kept for these tools only, and cut at so many characters.
RESULT_TOOLS, RESULT_CHARS = ("Bash", "Agent", "Task"), 65_536
SCHEMA_WRITTEN, SCHEMA_READ = 2, (1, 2)
