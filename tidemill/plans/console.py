"""The report as lines for a terminal."""

from __future__ import annotations

from collections.abc import Iterator

from tidemill.functions.display import bytes_text

# Names of confidences.
CONFIDENCES = {"en": {"high": "high", "medium": "medium", "low": "low"}, "ru": {"high": "высокая", "medium": "средняя", "low": "низкая"}}


def plan_lines(plan: dict, *, examples: int = 5, lang: str = "en") -> Iterator[str]:
    """Categories with their examples, totals, what is reported only, and the largest videos."""
    if not plan["run_id"]:
        yield "No classification yet. Run `tidemill classify` first."
        return
    names = CONFIDENCES.get(lang, CONFIDENCES["en"])
    yield f"{'category':<20}{'count':>8}{'size':>12}  {'confidence':<10} enabled"
    for own in plan["categories"]:
        confidence = names.get(own.get("confidence"), own.get("confidence") or "")
        yield f"{own['category']:<20}{own['n']:>8,}{bytes_text(own['bytes'] or 0):>12}  {confidence:<10} {'yes' if own['enabled'] else 'no'}"
        for shown in own["examples"][:examples]:
            yield f"    {shown['path']}  ({bytes_text(shown['size'])}) — {shown['reason']}"
    totals = plan["totals"]
    yield f"{'total (enabled)':<20}{totals['candidates']:>8,}{bytes_text(totals['bytes'] or 0):>12}"
    live, pairs, large = plan["live_photos"], plan["edited_pairs"], plan["large_videos"]
    yield f"Report only: Live Photo videos {live['count']:,} ({bytes_text(live['bytes'] or 0)}); edited pairs {pairs['count']:,} ({bytes_text(pairs['bytes'] or 0)}); largest videos listed: {len(large)}"
    for video in large[:examples]:
        saving = f", HEVC could save ~{bytes_text(video['saving'])}" if video["saving"] else ""
        yield f"    {video['rel_path']}  {bytes_text(video['size'])} {video['codec'] or '?'} {video['width'] or '?'}x{video['height'] or '?'} {bytes_text((video['bitrate'] or 0) / 8)}/s{saving}"
