"""Plain loops that say what the operators must compute."""

from pyspark.sql import functions as F

CHAPTERS = (
    "project_id string, chapter_id long, title string, content_json string, plain_text string, "
    "revision_number long, position long"
)
FACTS = "fact_id string, project_id string, chunk_id string, claim string, quote string, status string, revision long"


def chapters(spark, *rows):
    """(project, id, title, text, revision) each."""
    full = [(p, i, t, '{"type":"doc"}', x, r, 0) for p, i, t, x, r in rows]
    return spark.createDataFrame(full, CHAPTERS)


def ready_jobs(chapters_df):
    return chapters_df.select("chapter_id", F.lit("ready").alias("status"))


def chunks_of(text):
    """(index, start, end) by walking the text once."""
    out, at, total = [], 1, len(text)
    while at <= total:
        end = min(at + 3199, total)
        if end < total:
            window = text[end - 701 : end]
            cut = max(window.rfind(c) for c in "\n.!? ")
            if cut >= 0:
                end = end - 700 + cut
        if text[at - 1 : end].strip(" "):
            out.append((len(out), at - 1, end))
        if end >= total:
            break
        at = end - 319
    return out


def fold(events, start):
    """[(event_id, met, applied)] for events (event_id, at, base, usable) of one key."""
    now, out = start, []
    for event_id, _, base, usable in sorted(events, key=lambda e: (e[1], e[0])):
        ok = usable and base == now
        out.append((event_id, now, ok))
        now += ok
    return out


def quota(times, limit, window, spacing):
    """Decisions for one user's sorted (at, id)."""
    held, out = [], {}
    for at, event in sorted(times):
        held = [t for t in held if t > at - window]
        if len(held) >= limit:
            out[event] = "AI_DAILY_LIMIT"
        elif held and held[-1] > at - spacing:
            out[event] = "AI_RATE_LIMIT"
        else:
            out[event] = "accepted"
            held.append(at)
    return out


def pack(texts, budget=22000, cap=12000):
    left, taken, cut = budget, [], False
    for text in texts:
        part = text[: max(0, min(left, cap))]
        cut |= len(part) < len(text)
        taken.append(part)
        left -= len(part)
    return [t for t in taken if t], cut
