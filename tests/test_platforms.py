"""Packages by mode, against documents and indexes put together by hand."""

import pytest

from quernstone.sources.platforms import BOTH, SEPARATE, UNIFIED, export_mode, export_packages, read_packages

CONVERSATIONS = "conv_id long, title string, source string, created string, source_platform string, more string"
MESSAGES = "conv_id long, msg_index long, role string, content string"
ENTITIES = "conv_id long, type string, value string"
ATTACHMENTS = "conv_id long, file_name string, media_type string, summary string"
PERMISSIONS = "conv_id long, can_read boolean"

ROWS = [
    (1, "Ride", "a.json", "2024-01-02", "My App!", "x"),
    (2, "Boat", "b.json", "2024-01-01", "My--App", None),
    (3, None, "from-OpenAI.json", None, "", None),
    (4, "Hidden", "c.json", "2023-01-01", "Grok", None),
    (5, "Boat", None, "2024-05-01", "My_App", None),
    (6, "Odd", "nobody.json", "2024-06-01", None, None),
]
SAID = [(1, 1, "USER", "hi"), (1, 2, None, None), (2, 1, "assistant", "a\n\nb"), (4, 1, "user", "secret"), (99, 1, "user", "of none"), (5, 1, "", "x")]
NAMED = [(1, "URL", "z"), (1, "Date", "2024"), (1, "Date", "2024"), (4, "URL", "hidden"), (99, "URL", "none")]
FILES = [(2, None, None, None), (2, "a.txt", "text", "short"), (4, "h", "m", "s")]
ENTRIES = [(4, True), (4, False), (1, True), (2, None), (None, False)]


def made(spark, tmp_path, mode=BOTH, rows=ROWS, strict=False):
    frames = [spark.createDataFrame(r, s) for r, s in ((rows, CONVERSATIONS), (SAID, MESSAGES), (NAMED, ENTITIES), (FILES, ATTACHMENTS), (ENTRIES, PERMISSIONS))]
    folder = str(tmp_path / "out")
    export_packages(*frames, folder, mode, strict)
    return read_packages(spark, folder)


def manifests(t):
    return {(r.kind, r.package, r.platform_name): (r.conversations, r.messages, r.entities, r.attachments, r.first_imported, r.last_imported) for r in t["manifest"].collect()}


def text(t, kind, package, conv_id):
    rows = t["documents"].where(f"kind = '{kind}' AND package = '{package}' AND conv_id = {conv_id}").collect()
    return "".join(r.text for r in sorted(rows, key=lambda r: (r.section, r.at, r.text)))


def index(t, kind, package):
    rows = sorted(t["index"].where(f"kind = '{kind}' AND package = '{package}'").collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(len(rows)))
    return [r.line for r in rows]


def test_both(spark, tmp_path):
    t = made(spark, tmp_path)
    assert manifests(t) == {
        ("unified", "unified", "Unified"): (5, 4, 3, 2, "2024-01-01", "2024-06-01"),
        ("platform", "My_App", "My App!"): (2, 3, 3, 0, "2024-01-02", "2024-05-01"),  # two names that are one when made safe
        ("platform", "My--App", "My--App"): (1, 1, 0, 2, "2024-01-01", "2024-01-01"),
        ("platform", "ChatGPT", "ChatGPT"): (1, 0, 0, 0, None, None),
        ("platform", "Unknown", "Unknown"): (1, 0, 0, 0, "2024-06-01", "2024-06-01"),
        ("platform", "Grok", "Grok"): (0, 0, 0, 0, None, None),
        ("root", "", "My App!"): (1, 2, 3, 0, "2024-01-02", "2024-01-02"),
        ("root", "", "My_App"): (1, 1, 0, 0, "2024-05-01", "2024-05-01"),
        ("root", "", "My--App"): (1, 1, 0, 2, "2024-01-01", "2024-01-01"),
        ("root", "", "ChatGPT"): (1, 0, 0, 0, None, None),
        ("root", "", "Unknown"): (1, 0, 0, 0, "2024-06-01", "2024-06-01"),
        ("root", "", None): (5, 4, 3, 2, "2024-01-01", "2024-06-01"),
    }
    whole = "# Ride\n\n**ID:** `1` | **Source:** `a.json`\n\n## Entities\n\n- **2024** (Date)\n- **2024** (Date)\n- **z** (URL)\n\n## Messages\n\n### User\n\nhi\n\n### User\n\n\n\n"
    assert text(t, "unified", "unified", 1) == text(t, "platform", "My_App", 1) == whole
    assert text(t, "platform", "ChatGPT", 3) == "# 3\n\n**ID:** `3` | **Source:** `from-OpenAI.json`\n\n## Messages\n\n"
    assert t["documents"].where("conv_id IN (4, 99) OR text LIKE '%secret%'").count() == 0
    assert index(t, "platform", "My--App") == [
        "# My--App Knowledge Package\n", "**Conversations:** 1 | **Entities:** 0 | **Attachments:** 2\n", "\n## Index of Conversations\n", "- **Boat** (`2`) - 1 messages",
        "\n## Index of Attachment Knowledge\n", "- `a.txt` (text) - Summary: short", "- `attachment` (unknown) - Summary: ",
    ]
    lines = index(t, "unified", "unified")
    assert lines[0] == "# Unified Knowledge Base\n" and [x for x in lines if x.startswith("- **")] == ["- **3** (`3`) - 0 messages", "- **Boat** (`2`) - 1 messages", "- **Boat** (`5`) - 1 messages", "- **Odd** (`6`) - 0 messages", "- **Ride** (`1`) - 2 messages"]
    assert index(t, "platform", "Grok")[1] == "**Conversations:** 0 | **Entities:** 0 | **Attachments:** 0\n"
    assert sorted((r.kind, r.package, r.id, r.message_count) for r in t["archive"].collect() if r.id in "12") == [("platform", "My--App", "2", 1), ("platform", "My_App", "1", 2), ("unified", "unified", "1", 2), ("unified", "unified", "2", 1)]


@pytest.mark.parametrize("mode, kinds", [(UNIFIED, {"unified"}), (SEPARATE, {"platform"})])
def test_one_mode(spark, tmp_path, mode, kinds):
    t = made(spark, tmp_path, mode)
    for name in ("documents", "archive", "index"):
        assert {r.kind for r in t[name].select("kind").distinct().collect()} == kinds
    assert {r.kind for r in t["manifest"].collect()} == kinds | {"root"}
    assert {r.export_mode for r in t["manifest"].collect()} == {mode}


def test_strict_shows_only_what_has_an_entry(spark, tmp_path):
    assert {r.id for r in made(spark, tmp_path, strict=True)["archive"].collect()} == {"1", "2"}


def test_nothing_to_export(spark, tmp_path):
    t = made(spark, tmp_path, rows=[])
    assert manifests(t) == {("unified", "unified", "Unified"): (0, 0, 0, 0, None, None), ("root", "", None): (0, 0, 0, 0, None, None)}
    assert t["documents"].count() == t["archive"].count() == 0
    assert index(t, "unified", "unified")[1:] == ["**Conversations:** 0 | **Entities:** 0 | **Attachments:** 0\n", "\n## Index of Conversations\n"]


def test_no_package_without_its_manifest(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_packages(spark, str(tmp_path / "none"))


def test_modes_by_their_words():
    given = [None, "", " unified ", "Unified only", "by source", "SEPARATE", "unified and by source", "both unified", "all"]
    assert [export_mode(m) for m in given] == [BOTH, BOTH, UNIFIED, UNIFIED, SEPARATE, SEPARATE, SEPARATE, BOTH, BOTH]
