import io
import json

from ragloom import __main__ as cli
from ragloom.commands import Index
from ragloom.server import Server
from ragloom.sources.store import Store


def test_messages_and_tools(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    words = "The only passage of this index, long enough to be kept as a chunk of its own by the chunker of the engine."
    (root / "a.txt").write_text(words)
    s = Server(Index(Store(spark, f"file://{tmp_path}/i")), start=lambda job: job())
    ask = lambda method, at=1, **params: s.answer(json.dumps({"jsonrpc": "2.0", "id": at, "method": method, "params": params}))
    text = lambda name, **args: ask("tools/call", name=name, arguments=args)["result"]["content"][0]["text"]
    assert ask("initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert len(ask("tools/list")["result"]["tools"]) == 6 and ask("prompts/list")["result"] == {"prompts": []}
    assert ask("nothing")["error"]["code"] == -32601 and s.answer("{")["error"]["code"] == -32700
    assert ask("tools/call")["error"]["code"] == -32602 and s.answer('{"method": "x"}') is None
    assert ask("tools/call", name="other")["result"]["isError"] and ask("tools/call", name="rag_search")["result"]["isError"]
    assert ask("tools/call", name="rag_search", arguments={"query": "q", "limit": "x"})["error"]["code"] == -32602
    assert text("rag_search", query="q") == "No results found matching your query."
    assert text("rag_ingest_source", source_type="dir", uri=str(root)).startswith("Started") and not s.failures
    assert words in text("rag_search", query=words, limit=99) and "1 documents" in text("rag_sources")
    assert text("rag_reindex") == "Started reindex." and text("rag_update") == "Started update." and not s.failures
    assert "- chunks: 1" in text("rag_status")
    out = io.StringIO()
    s.serve(['{"id": 1, "method": "resources/list"}\n', "\n", '{"method": "notifications/initialized"}\n'], out)
    assert out.getvalue().count("\n") == 1


def test_command_line(spark, tmp_path, capsys):
    at = ["--config", str(tmp_path / "c.toml"), "--json"]
    assert cli.main([*at, "status"], spark) == 1  # no settings yet
    assert cli.main([*at, "init"], spark) == 0 and cli.main([*at, "init"], spark) == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# T\n\n" + "words of a file " * 20)
    capsys.readouterr()
    assert cli.main([*at, "ingest", "dir", str(tmp_path / "d"), "--name", "mine"], spark) == 0
    assert json.loads(capsys.readouterr().out)["docs_changed"] == 1
    assert cli.main([*at, "query", "words", "-k", "1", "--source", "mine", "--min-score", "0"], spark) == 0
    assert cli.main([*at, "completions", "bash"], spark) == 0 and cli.main([*at, "db", "reset"], spark) == 1
    assert cli.main([*at, "remove", "nobody"], spark) == 1 and cli.main([*at, "db", "reset", "--yes"], spark) == 0
