"""Access counters and request classification, in batch; foliant.streaming has the incremental form."""

from __future__ import annotations

from foliant.plans.sql import Plan, as_frame

# Needles of user agents (any case), and the score at or below which a request counts as automatic.
HEALTH_CHECKS = (
    "cf-healthchecks", "cloudflare-healthchecks", "cloudflare healthchecks", "uptimerobot", "pingdom", "betteruptime", "better uptime", "betterstack",
    "healthcheck", "health-check", "health_check", "kube-probe", "googlehc", "amazon-route53-health-check", "aws-healthcheck", "elb-healthchecker",
    "statuscake", "site24x7", "freshping", "uptime-kuma", "uptime kuma", "newrelicsynthetics", "datadog/synthetics", "smokeping", "nodeping", "paessler", "prtg",
)
DENYLIST = (
    "googlebot", "google-inspectiontool", "adsbot-google", "apis-google", "mediapartners-google", "storebot-google", "bingbot", "bingpreview", "msnbot",
    "duckduckbot", "baiduspider", "yandexbot", "yandex.com/bots", "yandex", "gptbot", "chatgpt-user", "oai-searchbot", "claudebot", "anthropic-ai", "claude-web",
    "bytespider", "petalbot", "semrushbot", "semrush", "ahrefsbot", "ahrefssiteaudit", "ahrefs", "dotbot", "mj12bot", "ccbot", "applebot", "facebookexternalhit",
    "meta-externalagent", "facebot", "twitterbot", "linkedinbot", "slackbot", "discordbot", "telegrambot", "whatsapp", "redditbot", "pinterestbot", "embedly",
    "quora link preview", "outbrain", "ia_archiver", "archive.org_bot", "sogou", "exabot", "seznambot", "qwantify", "screaming frog", "serpstatbot", "dataforseo",
    "seokicks", "megaindex", "zoominfobot", "scrapy", "phantomjs", "headlesschrome", "lighthouse", "pagespeed", "gtmetrix", "curl/", "wget/", "python-requests",
    "python-urllib", "aiohttp/", "httpx/", "go-http-client", "java/", "libwww-perl", "okhttp", "node-fetch", "undici", "axios/", "postmanruntime", "insomnia/",
)
SCORE = 30
METHOD_SCORE, METHOD_UA = "cf.botManagement.score + ua_denylist + healthcheck_ua", "ua_denylist + healthcheck_ua"
RESERVED = ("__views__", "__views_human__", "__views_bot__", "__total__", "__downloads_human__", "__downloads_bot__", "__github__")
COUNT = r"^\s*([+-]?[0-9]+)"


def _any(d, x: str, needles: tuple[str, ...]) -> str:
    pattern = "|".join("".join("\\" + c if c in ".|*+?()[]{}^$" else c for c in n) for n in needles)
    return d.like(f"lower(coalesce({x}, ''))", pattern)


def classify(p: Plan, src: str) -> str:
    """bucket, reason and method of requests (request_id, ua, score, verified); a score counts if it is above 0."""
    d = p.d
    s = p.add("s", f"SELECT request_id, ua, CASE WHEN score > 0 THEN CAST(floor(score) AS BIGINT) END AS score, verified FROM {src}")
    reason = f"""CASE WHEN {_any(d, 'ua', HEALTH_CHECKS)} THEN 'healthcheck_ua' WHEN verified THEN 'verified_bot' WHEN score <= {SCORE} THEN 'bot_score'
      WHEN {_any(d, 'ua', DENYLIST)} THEN 'ua_denylist' WHEN trim(coalesce(ua, '')) = '' THEN 'empty_ua' ELSE 'default' END"""
    r = p.add("r", f"SELECT request_id, ua, score, verified, {reason} AS reason, CASE WHEN score IS NOT NULL OR verified IS NOT NULL THEN '{METHOD_SCORE}' ELSE '{METHOD_UA}' END AS method FROM {s}")
    return p.add("classified", f"SELECT *, CASE WHEN reason = 'default' THEN 'human' ELSE 'bot' END AS bucket FROM {r}")


def dims(p: Plan, src: str, project: str = "project", owner: str = "owner", repo: str = "repo", branch: str = "main") -> str:
    """Owner, repo, branch, fork flag and counter key of requests (request_id, owner, repo, branch, fork).

    Empty values take the defaults; owner/name in repo or fork wins; fork is '1' if asked for or if the
    repository is not the default one.
    """
    d = p.d
    e = lambda c, v: f"coalesce(nullif({c}, ''), '{v}')"
    two = lambda c: f"{c} LIKE '%/%'"
    part = lambda c, i: d.at(d.split(c, "/"), str(i))
    a = p.add("a", f"SELECT request_id, CASE WHEN {two('repo')} THEN {e(part('repo', 1), owner)} ELSE {e('owner', owner)} END AS owner, CASE WHEN {two('repo')} THEN {e(part('repo', 2), repo)} ELSE {e('repo', repo)} END AS repo, {e('branch', branch)} AS branch, nullif(fork, '') AS fork FROM {src}")
    b = p.add("b", f"SELECT request_id, CASE WHEN {two('fork')} THEN {part('fork', 1)} ELSE owner END AS owner, CASE WHEN {two('fork')} THEN {part('fork', 2)} ELSE repo END AS repo, branch, CASE WHEN fork IS NOT NULL AND fork NOT IN ('0', 'false') THEN '1' ELSE '0' END AS fork FROM {a}")
    c = p.add("c", f"SELECT request_id, owner, repo, branch, CASE WHEN lower(concat(owner, '/', repo)) <> '{(owner + '/' + repo).lower()}' THEN '1' ELSE fork END AS fork FROM {b}")
    return p.add("dims", f"SELECT *, concat('{project}|', owner, '|', repo, '|', branch, '|', fork) AS key FROM {c}")


def counted(p: Plan, src: str) -> str:
    """Exact counts by key of an event relation (key); nothing is lost to concurrent writers."""
    return p.add("counted", f"SELECT key, count(*) AS n FROM {src} GROUP BY key")


def split_counts(p: Plan, src: str) -> str:
    """Downloads and views by bucket, and in all, of classified events (kind, bucket)."""
    return p.add("split", f"SELECT kind, count(*) AS total, count(CASE WHEN bucket = 'human' THEN 1 END) AS human, count(CASE WHEN bucket = 'bot' THEN 1 END) AS bot FROM {src} GROUP BY kind")


def as_count(d, x: str) -> str:
    """The integer at a text's beginning; 0 if there is none or it is not positive."""
    digits = f"nullif({d.one(x, COUNT, 1)}, '')"
    return f"greatest(coalesce({d.parsed(digits, 'BIGINT')}, 0), 0)"


def stats(p: Plan, src: str, project: str = "project") -> str:
    """(level, name, n): roll-ups of counters (key, n) by repo, branch, fork and in all, in one pass.

    Reserved keys, counts under 1 and keys of fewer than five parts are left out; a stored total wins.
    """
    d = p.d
    reserved = ", ".join(f"'{project}|{r}'" for r in RESERVED)
    k = p.add("k", f"SELECT key, n, {d.split('key', '|')} AS part FROM {src} WHERE key NOT IN ({reserved})")
    c = p.add("c", f"SELECT concat({d.at('part', '2')}, '/', {d.at('part', '3')}) AS repo, {d.at('part', '4')} AS branch, CASE WHEN {d.at('part', '5')} = '1' THEN '1' ELSE '0' END AS fork, n FROM {k} WHERE {d.size('part')} >= 5 AND n > 0")
    g = p.add("g", f"SELECT CAST(grouping(repo) AS INT) AS gr, CAST(grouping(branch) AS INT) AS gb, CAST(grouping(fork) AS INT) AS gf, repo, branch, fork, sum(n) AS n FROM {c} GROUP BY GROUPING SETS ((repo), (branch), (fork), ())")
    total = p.add("total", f"SELECT max(CASE WHEN key = '{project}|__total__' AND n > 0 THEN n END) AS total FROM {src}")
    return p.add(
        "stats",
        f"""SELECT CASE WHEN gr = 0 THEN 'repo' WHEN gb = 0 THEN 'branch' WHEN gf = 0 THEN 'fork' ELSE 'total' END AS level, coalesce(repo, branch, fork, '') AS name,
        CAST(CASE WHEN gr = 1 AND gb = 1 AND gf = 1 THEN coalesce(total, n, 0) ELSE n END AS BIGINT) AS n FROM {g} CROSS JOIN {total}""",
    )


def remainder(p: Plan, src: str) -> str:
    """(name, views, downloads and their human and bot parts): human is at most the whole, bot the rest; holds: they add up."""
    part = lambda k: f"least({k}_human, {k}) AS {k}_human, {k} - least({k}_human, {k}) AS {k}_bot"
    r = p.add("r", f"SELECT name, views, downloads, {part('views')}, {part('downloads')} FROM {src}")
    return p.add("shape", f"SELECT *, views_human + views_bot = views AND downloads_human + downloads_bot = downloads AS holds FROM {r}")


def mesh(p: Plan, src: str) -> str:
    """(id, enabled, status, live, locked, isolated) of mesh documents (id, doc), doc as JSON text.

    Counts are the first that is a number of at least 0 among the alternatives, and 0 unless enabled.
    """
    d = p.d
    plain = lambda path: f"replace({d.json('doc', path)}, ',', '')"
    number = lambda path: f"CASE WHEN {d.parsed(plain(path), 'DOUBLE')} >= 0 THEN CAST(floor({d.parsed(plain(path), 'DOUBLE')}) AS BIGINT) END"
    first = lambda k, more=(): "coalesce(" + ", ".join(number(x) for x in (f"rollup.{k}", f"rollup.{k}_nodes", f"rollup.{k}_count", k, f"{k}_nodes", *more, f"{k}_count")) + ", 0)"
    on = lambda path: f"lower(trim(coalesce({d.json('doc', path)}, ''))) IN ('true', '1', 'on', 'enabled', 'live')"
    e = p.add("e", f"SELECT id, ({on('enabled')} OR {on('mesh_enabled')} OR lower(coalesce({d.json('doc', 'status')}, '')) = 'on') AS enabled, {first('live', ('mesh_live_nodes',))} AS live, {first('locked')} AS locked, {first('isolated')} AS isolated FROM {src}")
    shown = ", ".join(f"CASE WHEN enabled THEN {k} ELSE 0 END AS {k}" for k in ("live", "locked", "isolated"))
    return p.add("mesh", f"SELECT id, enabled, CASE WHEN enabled THEN 'on' ELSE 'off' END AS status, {shown} FROM {e}")


classify_requests, parse_dims, count_keys, collect_stats, display_remainder, parse_mesh = map(as_frame, (classify, dims, counted, stats, remainder, mesh))
