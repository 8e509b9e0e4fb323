"""Whether a news item is an advertisement: phrases, addresses and titles of card round-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marks of official documents, which are never advertisements
OFFICIAL = (
    "press release", "for immediate release", "official statement", "official announcement", "filing", "sec filing", "regulatory filing",
    "news brief", "announcement:", "statement:", "report:",
)
# fixed values: plain marks of advertisements; "save \d+%" is read as it stands
PLAIN = (
    "sponsored", "sponsored content", "advertisement", "advertisements", "paid partnership", "affiliate", "buy now", "shop now", "limited time offer",
    "special offer", "discount", "sale", "promo code", "coupon", "deal", "deals", r"save \d+%", "click here to", "order now", "get yours", "shop here",
    "promotional", "promotion", "marketing", "advertorial",
)
# fixed values: phrases of card and loan offers
FINANCE = (
    "subject to credit approval", "member fdic", "member fdic.", "0% intro apr", "introductory apr", "intro apr", "see issuer", "see rates and fees",
    "rates & fees", "rates and fees", "variable apr", "credit card offer", "credit card offers", "best credit cards", "cash back rewards",
    "earn unlimited", "points per dollar", "terms apply", "cnn underscored", "partner offer", "paid partner", "bonus miles after", "bonus points after",
    "earn miles on every", "earn points on every", "prequalified offer", "pre-approved offer",
)
# fixed values: phrases of software for lawyers
LEGAL = (
    "product spotlight", "product spotlight:", "lexis create", "lexis® create", "lexis create+", "lexis® create+", "create+ for litigators",
    "for litigators —", "lexis+ ai", "lexis+ for", "lexisnexis create", "powered by lexisnexis", "sponsored by lexis", "sponsored by lexisnexis",
    "presented by lexisnexis", "westlaw edge free trial", "try westlaw free", "westlaw precision", "practical law free trial", "casetext co-counsel",
    "harvey ai for law firms", "legal tech demo", "schedule your demo", "book a demo with", "free firm trial", "legal practice management software",
    "case management software for lawyers", "westlaw free trial", "lexis free trial", "lexisnexis free trial", "try lexis", "try westlaw",
    "upgrade to westlaw", "upgrade to lexis",
)
# fixed values: phrases of drug marketing
MEDICINE = (
    "savings card", "copay card", "instant savings offer", "pay as little as $", "pay no more than", "$0 copay", "eligible commercially insured",
    "eligible patients may pay", "not actual patients", "not actual patient", "not a real patient", "actor portrayal", "paid actor", "paid actors",
    "paid spokesperson", "prescribing information and medication guide", "scroll for important safety", "scroll for isi",
    "important safety information, including boxed warning", "fda-approved treatment option", "prescription treatment website",
    "get your prescription online", "same-day prescription delivery", "order medication online", "weight loss prescription online", "miracle supplement",
    "this statement has not been evaluated by the fda", "not intended to diagnose, treat, cure",
)
# fixed values: phrases of chatbot vendors
CHATBOTS = (
    "ai chatbot free trial", "no-code ai chatbot", "no-code chatbot", "white-label ai chatbot", "white-label chatbot", "custom ai chatbot for your",
    "ai chatbot for your business", "ai chatbot for your website", "automate customer service with ai", "customer service ai chatbot",
    "conversational ai platform", "enterprise ai chatbot", "sales ai bot", "ai sdr", "ai sales assistant", "hire an ai employee",
    "digital worker powered by ai", "replace your support team with ai", "gpt for your business", "custom gpt for your", "build your own chatgpt",
    "clone yourself with ai", "deploy your llm in minutes", "rag-as-a-service", "try our ai assistant", "book a demo with our ai",
    "start your free ai trial", "unlimited ai messages", "ai agent free trial", "virtual assistant for your sales team",
    "automate your workflow with our ai", "get more leads with ai bots",
)
# fixed values: parts of addresses of shops, of card comparisons, and of advertisements
SHOP_URLS = ("/cnn-underscored", "/underscored/", "/cnn/cnn-underscored", "/videos/cnn-underscored")
CARD_URLS = (
    "nerdwallet.com", "bankrate.com", "thepointsguy.com", "creditcards.com", "cardratings.com", "wallethub.com", "comparecards.com", "doctorofcredit.com",
    "millionmilesecrets.com", "upgradedpoints.com", "/personal-finance/credit-cards", "/money/credit-cards", "/finance/credit-cards",
)
AD_URLS = ("/ad/", "/ads/", "/advertisement/", "/sponsored/", "/promo/", "/promotion/", "/shop/", "/store/", "/buy/", "/deal/", "/offer/")
# fixed values: words of news about cards, and forms of titles that compare cards
CARD_NEWS = (
    r"\b(bill|bills|law|hearing|hearings|vote|votes|voted|cfpb|ftc|fcc|lawsuit|lawsuits|settlement|settlements|regulation|regulations|interchange|"
    r"congress|senate|house|committee)\b"
)
CARD_TITLES = (
    r"(?i)^(the\s+)?(best|top|our|these)\s+\d+\s+.*\bcredit\s+cards?\b", r"(?i)^(the\s+)?(best|top)\s+(cash[-\s]?back|rewards|travel|student|business)\s+cards?\b",
    r"(?i)^(compare|comparing)\s+(the\s+)?(best\s+)?.*\bcredit\s+cards?\b", r"(?i)\bcredit\s+card\s+rewards\b.*\b(best|top|our|compare)\b",
)


def _holds(low: Column, terms: Sequence[str]) -> Column:
    """Whether a text holds one of the terms. A term that holds another of them adds nothing and isn't sought."""
    least = [t for t in terms if not any(other != t and other in t for other in terms)]
    out = F.lit(False)
    for term in least:
        out = out | F.contains(low, F.lit(term))
    return out


def compares_cards(title: Column) -> Column:
    """Whether a title of six characters or more reads like a round-up of credit cards, and not like news about them."""
    head = F.coalesce(title, F.lit(""))
    shaped = F.lit(False)
    for form in CARD_TITLES:
        shaped = shaped | head.rlike(form)
    return (F.length(F.trim(head)) >= 6) & shaped & ~F.lower(head).rlike(CARD_NEWS)


def is_advertisement(title: Column, content: Column, url: Column) -> Column:
    """Whether an item is an advertisement. Nulls are empty; a mark of an official document anywhere overrules all else."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    whole, at = F.lower(F.concat_ws(" ", blank(title), blank(content), blank(url))), F.lower(blank(url))
    promoted = _holds(whole, PLAIN + FINANCE + LEGAL + MEDICINE + CHATBOTS)
    return ~_holds(whole, OFFICIAL) & (compares_cards(title) | promoted | _holds(at, SHOP_URLS + CARD_URLS + AD_URLS))
