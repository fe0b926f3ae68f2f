"""The topic gate: whether a story is about technology, by ordered rules over its title and the beginning of its summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.gates import anywhere

# What a technical title, and one about being paid by a platform, sounds like.
EARNING = anywhere(
    "staking|restaking|validators?|slashing|mainnet|testnet|hard ?forks?",
    "on-?chain|smart contracts?|rollups?|layer[- ]?2|sequencers?",
    "liquidity (pool|provider)|tvl|governance (vote|proposal)|tokenomics",
    "revenue share|payout(s|ed)?|monetis(e|ed|ation)|monetiz(e|ed|ation)",
    "creator fund|tip(s|ping)?|affiliate (program|payouts?)|commission rate",
    "(grants?|bounty|bounties|rewards?|incentives?|airdrop) programs?",
    "rewards? (structure|scheme|rate|pool|distribution|split)",
    "(emission|reward) (schedule|curve)|fee (split|switch|rebate)",
    r"apy|apr\b|yield (farming|program)?",
    r"(paid|creator|seller|publisher|partner|author|contributor) [\w ]{0,12}(subscriptions?|pricing|plans?|tiers?)",
    "per[- ](task|seat|unit|item|job|gig|listing) pricing",
)
TECHNICAL = [r"(?i)(^|[^a-z0-9])v?\d+\.\d+(\.\d+)?([-.][a-z0-9]+)?([^a-z0-9]|$)"] + anywhere(
    "releas(e|ed|es|ing)|now available|general availability|shipping",
    r"beta|alpha|release candidate|rc\d|nightly|preview build",
    "changelog|patch(es|ed|ing)?|hotfix|bugfix|regression",
    "deprecat(e|ed|ing|ion)|end of life|eol|breaking change|migrat(e|ed|ion|ing)",
    "api|sdk|cli|repl|ide|orm|rpc|grpc|graphql|rest api|webhook",
    "open[- ]source|source code|repositor(y|ies)|pull requests?|commits?|fork(ed)?",
    "compiler|interpreter|runtime|kernel|driver|firmware|toolchain|linker",
    "framework|librar(y|ies)|package|dependency|dependencies|module",
    "database|query|index(es|ing)?|schema|transaction|replica(tion)?|shard(ing)?",
    "latency|throughput|benchmark(s|ed|ing)?|profil(e|ed|ing)|memory leak|race condition",
    "algorithm|data structure|type system|garbage collect(or|ion)|concurrency",
    r"cve-\d{4}|vulnerabilit(y|ies)|exploits?|zero[- ]day|malware|ransomware",
    "phishing|breach|backdoor|privilege escalation|patch tuesday|hardening",
    "ddos|dns|bgp|tcp|udp|http/?[23]|botnets?|packets?|bandwidth|[tgm]bps",
    "encrypt(ed|ion)|authentication|authori[sz]ation|tls|ssl|oauth|certificates?",
    "how (we|i) (built|scaled|migrated|debugged|shipped|made)",
    "lessons (from|learned)|post-?mortem|deep dive|under the hood",
    "architecture|implementation|design of|internals|writing an?|building an?",
    "why (we|i) (chose|moved|left|rewrote|switched)",
    "self-?host(ed|ing)|on-?prem|cluster|container|serverless|edge (function|runtime)",
) + EARNING

# The rules in the order in which they are tried, as category, evidence that overturns them (none, a technical
# title: strong, or any sign of technology: signal), whether they bind a publisher that writes about itself, patterns, and phrases that switch the rule off.
SPECULATION = anywhere(
    "price (prediction|forecast|target|analysis)",
    r"(could|may|might|will|set to|poised to|expected to) (hit|reach|top|surge to|soar to|climb to) [$£€]?\d[\d,.]*",
    "(bull|bear) (run|market|case)|to the moon|next bull run",
    r"\d+x (gains?|returns?|profits?|potential)",
    r"(price|token|coin|btc|eth|xrp|stock|shares?) [\w ]{0,14}(surges?|soars?|plunges?|plummets?|rallies|tanks?|jumps?) \d+%",
    r"(best|top) \d* ?(crypto|coins?|tokens?|altcoins?|meme ?coins?) to (buy|watch|invest)",
    "(should you|worth) (buy|buying|investing)|buy (now|the dip)|before (it|they) (explodes?|moons?)",
    r"(coins?|tokens?|altcoins?) to (buy|watch) (now|today|in \d{4})",
    "investment (advice|opportunity)|not financial advice",
    r"how i (made|earned|turned) [$£€]?\d[\d,.]*",
    r"(make|earn) [$£€]\d[\d,.]*( |-)?(a|per) (day|week|month|year)",
    "passive income|get rich|financial freedom|quit my job",
    "earn free (crypto|money|bitcoin|tokens?)|free (crypto|bitcoin) (giveaway|airdrop)",
)
COMMERCE = anywhere(
    "deals?", "on sale", r"\d{1,3}% off", r"save (up to )?[$£€]?\d[\d,.]*", "discount(s|ed)?", "coupons?", "black friday|cyber monday|prime day|labor day|labour day|boxing day", "price (drop|cut|match)",
    "cheapest|lowest price|best price", "buying guide|gift (guide|ideas)", "shop (now|these)", "clearance", r"for (just |only )?[$£€]\d[\d,.]*", r"(under|below) [$£€]\d[\d,.]*",
    r"drops? to [$£€]\d[\d,.]*|now [$£€]\d[\d,.]* at", "best buy|amazon bonus|walmart|costco|newegg", r"savings|price (hike|hikes)|is now [$£€]\d[\d,.]*",
    "don'?t miss (this|these)|grab (it|one|this)|snag (a|this)", "pre-?order(s|ing)?",
)
ENTERTAINMENT = anywhere(
    r"season \d|episodes?|trailers?|box office|premieres?|spoilers?", "showrunner|screenwriter|soundtrack|the cast of|red carpet", "video games?|gameplay|dlc|expansion pack|speedrun",
    "xbox|playstation|nintendo|steam deck", "creative director|executive producer", "how to watch|where to stream|streaming (this|next) (week|month)", "celebrity|celebrities",
    "gamescom|comic-?con|the game awards|opening night live", "spin-?off (show|series)|confirmed cast|the cast|new series", "fighting game|roguelike|platformer|indie game|game studio|studio behind",
    "photographer of the year|film festival|blockbuster",
)
SPORT = anywhere("football|soccer|basketball|baseball|cricket|rugby|tennis|golf", "nba|nfl|mlb|nhl|ufc|premier league|la liga|serie a", r"world cup|olympics?|championships?|grand prix|formula 1|f1 \d", "fixtures?|kick-?off|half-?time|playoffs?")
POLITICS = anywhere(
    "elections?|voters?|ballot|campaign trail|polling station", "senate|congress|parliament|lawmakers?|legislature|governor", "president(ial)?|prime minister|minister|white house|kremlin|downing street",
    "tariffs?|sanctions?|embargo|geopolitic(s|al)", "war|invasion|ceasefire|troops|military|missiles?|drone (strike|interceptor)", "investigation into|opens? an inquiry|probe into|cease[- ]and[- ]desist",
    "immigration|deportation|asylum", "h-?1b|work visas?|student visas?|visa (application|holder|lottery|rules|uncertainty)", "antitrust|monopoly probe|regulators?|regulatory (crackdown|probe)",
    r"lawsuits?|sues?|sued|court (ruling|filing)|settlement|fined [$£€]?\d[\d,.]*", "democrat(s|ic)?|republican(s)?|conservative party|labour party", "propaganda|disinformation|influence operations?|think tanks?",
)
NO_POLITICS = anywhere(
    "cold war|great war|world war ?(i|ii|1|2)?|star wars|gears of war", "(price|format|browser|flame|edit|console|bidding|ad blocking) wars?", "war stor(y|ies)|tug of war",
    "(steering|packaging|governing) council|technical (steering )?committee", "(board|maintainer|core team|foundation|working group) election",
)
CRIME = anywhere("stolen|theft|robbery|burglary|shoplifting", "arrested|indicted|convicted|sentenced to|pleads? guilty|jailed|prison", "murder|homicide|assault|kidnapp?(ed|ing)|smuggl(ed|ing)")
CAPITAL = anywhere(r"raise[sd]? [$£€]?\d[\d,.]*[mbk]?|funding round|series [a-e] ", "seed round|valuation|ipo|goes public|stock (price|market)|shares? (fall|rise|jump|slide)", "market (size|share|research|forecast|outlook)")
REPORTS = anywhere(
    "earnings|quarterly results|revenue (growth|jumps|falls)|market cap|profit warning", "layoffs?|job cuts|hiring freeze|restructuring", "(survey|study|report|research) (finds|found|says|shows|reveals|suggests|warns)",
    "new (study|survey|report)|according to (a|the) (study|survey|report)", "analysts? (say|expect|predict)|poll (finds|of)",
    "(gartner|forrester|idc|mckinsey|bain|deloitte|accenture|pwc|kpmg) (say|says|find|finds|predict|predicts|expect|expects|report|reports)", r"state of \w+ report|\d{4} trends report",
    "% of (businesses|companies|organi[sz]ations|workers|employees|it leaders)",
)
CONSUMER = anywhere(
    "headphones|earbuds|smartwatch|fitness tracker|air fryer|mattress", "vacuum cleaner|robot vacuum", "jackets?|sneakers?|treadmill|e-?bike|scooter", r"the best \w+ (for|to|of|under)",
    "i (tried|tested|wore|used) (it|this|these)", "hands-on with|first impressions", "tvs?, |smart tv|streaming stick|soundbar",
)
RULES = [
    ("speculation", "none", True, SPECULATION, anywhere("block reward|emission (schedule|curve)|halving", "moonshot ai|kimi")),
    ("commerce", "none", False, COMMERCE, anywhere("went on sale|years ago|anniversary|back in d{4}")),
    ("entertainment", "none", True, ENTERTAINMENT, []),
    ("sport", "none", True, SPORT, []),
    ("politics", "strong", True, POLITICS, NO_POLITICS),
    ("crime", "strong", True, CRIME, []),
    ("business", "signal", True, CAPITAL, []),
    ("business", "strong", True, REPORTS, []),
    ("consumer", "signal", False, CONSUMER, []),
]
TRUSTED_KINDS = ("releases", "status", "research")
#: Characters of a summary that may decide.
TAIL = 400

_any = lambda text, patterns: text.rlike("|".join(f"(?:{p})" for p in patterns))


def technical_title(title: Column) -> Column:
    """Whether a title by itself sounds like technical writing."""
    return F.coalesce(_any(title, TECHNICAL), F.lit(False))


def off_topic(title: Column, summary: Column, source_kind: Column, first_party: Column, names_technology: Column) -> Column:
    """The category that refuses a story, null where none does.

    Rules without rescue look at the title only, the others at the beginning of the summary too. Kinds of sources that are technical by nature and empty
    titles pass. Unknown arguments count as no.
    """
    head, tail = F.trim(F.coalesce(title, F.lit(""))), F.left(F.coalesce(summary, F.lit("")), F.lit(TAIL))
    own, named = F.coalesce(first_party, F.lit(False)), F.coalesce(names_technology, F.lit(False))
    technical = _any(head, TECHNICAL)
    rescued = {"none": F.lit(False), "strong": technical, "signal": named | technical | _any(tail, TECHNICAL)}
    verdicts = []
    for category, rescue, binds_own, patterns, unless in RULES:
        where = head if rescue == "none" else F.concat_ws(" ", head, tail)
        refused = _any(where, patterns) & ~rescued[rescue]
        if unless:
            refused = refused & ~_any(head, unless)
        verdicts.append(F.when(refused if binds_own else refused & ~own, F.lit(category)))
    passes = F.coalesce(source_kind.isin(*TRUSTED_KINDS), F.lit(False)) | (head == "")
    return F.when(~passes, F.coalesce(*verdicts))


# Hosts whose feed items are the whole artefact, and what a source's type says of it: rung of evidence, independence.
SELF_DESCRIBING = ["github.com", "gitlab.com", "news.ycombinator.com", "lobste.rs", "sourceforge.net", "bitbucket.org"]


def histogram(rows, verdict: Column, title: str, by: str, samples: int = 3):
    """(by, verdict, n, samples) of a dry run of a gate: how many rows of each source a verdict takes, and their first titles in order."""
    judged = rows.select(by, F.coalesce(verdict, F.lit("kept")).alias("verdict"), title)
    some = F.slice(F.sort_array(F.collect_set(title)), 1, samples)
    return judged.groupBy(by, "verdict").agg(F.count("*").alias("n"), some.alias("samples"))


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; unknown conditions do not hold."""
    return reduce(lambda out, r: F.coalesce(out, r), [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons])
