import random
import re

from tidemark.operators.chunking import chunk, chunk_documents


def paths(text, **k):
    return [p for p, _ in chunk(text, **k)]


def test_nested_headings():
    text = "# Tutorial\n\nintro\n\n## Query Parameters\n\nbody\n\n### Optional parameters\n\nmore"
    assert paths(text, merge_tokens=0) == ["Tutorial", "Tutorial > Query Parameters", "Tutorial > Query Parameters > Optional parameters"]


def test_siblings_pop():
    assert paths("# Guide\n\n## First\n\na\n\n## Second\n\nb", merge_tokens=0) == ["Guide > First", "Guide > Second"]


def test_fence_stays_whole():
    code = "```python\n" + "\n\n".join(f"call({i})" for i in range(40)) + "\n```"
    found = chunk(f"# A\n\nprose\n\n{code}", target_tokens=20, merge_tokens=0)
    assert len(found) == 1 and "prose" in found[0][1] and code in found[0][1]


def test_unterminated_and_tilde_fences():
    found = chunk("# A\n\n~~~~\n# no heading\n\nx", merge_tokens=0)
    assert found == [("A", "~~~~\n# no heading\n\nx")]


def test_tiny_tail_is_merged_and_tiny_only_is_kept():
    text = "# Doc\n\n## Big Section\n\n" + "word " * 200 + "\n\n## Tail\n\nx"
    assert paths(text, target_tokens=500, merge_tokens=120) == ["Doc > Big Section"]
    assert paths("# Only\n\nx", merge_tokens=120) == ["Only"]


def test_overlap_repeats_last_units():
    units = [f"{i}" * 30 for i in range(9)]
    found = [c for _, c in chunk("\n\n".join(units), target_tokens=60, merge_tokens=0)]
    assert len(found) > 1 and all(b.startswith(a.split("\n\n")[-1]) for a, b in zip(found, found[1:], strict=False))
    assert all(any(u in c for c in found) for u in units)


def test_dataframe(spark):
    docs = spark.createDataFrame([("k", "# A\n\nb", "u", "v"), ("n", None, "u", "v"), ("e", "", "u", "v")], "doc_key string, text string, source_url string, doc_version string")
    assert [tuple(r) for r in chunk_documents(docs).collect()] == [("k", "u", "v", 0, "A", "b")]


def plain_blocks(text):
    """(path, code?, text) of every block, line by line, and the numbers of blocks that headings stand before."""
    stack, found, fence, held, sections = [], [], None, [], {0}

    def close(code):
        if held:
            found.append((" > ".join(t for _, t in stack), code, "\n".join(held) if code else "\n".join(held).strip()))
            held.clear()

    for line in text.splitlines():
        opens, heading = re.match(r"\s*(`{3}|~{3})", line), re.match(r"(#{1,6})\s+(.*\S)\s*$", line)
        if fence:
            held.append(line)
            if line.strip().startswith(fence):
                close(True)
                fence = None
        elif opens:
            close(False)
            fence = opens[1]
            held.append(line)
        elif heading:
            close(False)
            stack = [x for x in stack if x[0] < len(heading[1])] + [(len(heading[1]), heading[2])]
            sections.add(len(found))
        elif line.strip():
            held.append(line)
        else:
            close(False)
    close(bool(fence))
    return found, sorted(sections | {len(found)})


def plain_chunks(text, target, least):
    (found, edges), out, most = plain_blocks(text), [], target * 4
    for lo, hi in zip(edges, edges[1:], strict=False):
        units = []
        for _, code, block in found[lo:hi]:
            if code and units:
                units[-1] += "\n\n" + block
            else:
                units.append(block)
        held, size = [], 0
        for unit in units:
            if held and size + len(unit) > most:
                out.append((found[lo][0], "\n\n".join(held)))
                kept = []
                while held and sum(map(len, kept)) + len(held[-1]) <= int(0.15 * most):
                    kept.insert(0, held.pop())
                held, size = kept, sum(map(len, kept))
            held.append(unit)
            size += len(unit) + 2
        out.append((found[lo][0], "\n\n".join(held)))
    merged = out[:1]
    for path, content in out[1:]:
        if len(content) < least * 4:
            merged[-1] = (merged[-1][0], merged[-1][1] + "\n\n" + content)
        else:
            merged.append((path, content))
    return merged


def test_random_documents_equal_a_plain_fold():
    r = random.Random(6)
    lines = ["", "", "  ", "word", "é  two words ", "# One", "## Two { #id }", "### Three ", "#no heading", "```", "```python", "  ~~~", "~~~~", "x" * 40, "y" * 130, "    indented", "a # b"]
    for _ in range(3_000):
        text = "".join(r.choice(lines) + r.choice(["\n", "\n", "\r\n", "\n\n", "\u2028"]) for _ in range(r.randint(0, 30)))
        target, least = r.choice([5, 12, 30, 500]), r.choice([0, 3, 10])
        assert chunk(text, target, least) == plain_chunks(text, target, least), (text, target, least)
