"""The detectors' patterns and word lists: data only, shared by the span operators."""

from __future__ import annotations

from brindle.functions.text import DIGIT_WORDS

# Fixed values throughout: patterns are Unicode-aware and ignore case.
_WORD = "|".join(DIGIT_WORDS)
PHONE = {
    "international": r"\+\d{1,4}[\s.\-]?(?:\(?\d{1,4}\)?[\s.\-]?)?\d{1,4}[\s.\-]?\d{1,4}[\s.\-]?\d{1,9}",
    "us_format": r"(?:\+?1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?|\d{3}[\s.\-])\d{3}[\s.\-]?\d{4}(?:\s*(?:x|ext|extension)[\s.\-]?\d{1,5})?",
    "spaced": r"\b\d(?:\s+\d){6,14}\b",
    "separated": r"\b\d(?:[\s.\-]+\d){6,14}\b",
    "spelled": rf"\b(?:{_WORD})(?:[\s\-]+(?:{_WORD})){{6,14}}\b",
    "mixed": rf"\b(?:\d|{_WORD})(?:[\s.\-]+(?:\d|{_WORD})){{6,14}}\b",
}
PHONE_CONTEXT = [
    r"\b(?:call|text|phone|mobile|cell|contact|reach)\s+(?:me\s+)?(?:at|on)\b",
    r"\b(?:my|the)\s+(?:number|phone|mobile|cell)\s+(?:is|:)\b",
    r"\b(?:dial|ring)\b",
    r"\b(?:tel|phone|mob|cell)[:.]?\b",
]
EMAIL = {
    "standard": r"\b[a-zA-Z0-9][a-zA-Z0-9._+\-]*@[a-zA-Z0-9][a-zA-Z0-9.\-]*\.[a-zA-Z]{2,}",
    "spaced": r"\b[a-zA-Z0-9][a-zA-Z0-9._+\-]*\s+(?:at|@)\s+[a-zA-Z0-9][a-zA-Z0-9.\-\s]*\s+dot\s+[a-zA-Z]{2,}\b",
    "bracket": r"\b[a-zA-Z0-9][a-zA-Z0-9._+\-]*\s*[\[\(]?\s*(?:at|@)\s*[\]\)]?\s*[a-zA-Z0-9][a-zA-Z0-9.\-\s]*\s*[\[\(]?\s*dot\s*[\]\)]?\s*[a-zA-Z]{2,}\b",
    "alt_separator": r"\b[a-zA-Z0-9][a-zA-Z0-9._+\-]*[\s\(\[\{]*(?:at|@|AT|\(at\)|\[at\])[\s\)\]\}]*[a-zA-Z0-9][a-zA-Z0-9.\-\s]*[\s\(\[\{]*(?:dot|DOT|\(dot\)|\[dot\]|\.)[\s\)\]\}]*[a-zA-Z]{2,}\b",
    "mixed_dot": r"\b[a-zA-Z0-9][a-zA-Z0-9._+\-]*@[a-zA-Z0-9][a-zA-Z0-9.\-]*(?:\s+dot\s+|\s*\.\s*)[a-zA-Z]{2,}\b",
}
EMAIL_CUT = {"standard": 0.3, "spaced": 0.4, "bracket": 0.4, "alt_separator": 0.4, "mixed_dot": 0.4}
EMAIL_CONTEXT = [
    r"\b(?:email|mail|e-mail|contact)\s+(?:me\s+)?(?:at|on)\b",
    r"\bmy\s+(?:email|e-mail|mail)\s+(?:is|address)\b",
    r"\bsend\s+(?:me\s+)?(?:an?\s+)?(?:email|mail)\b",
    r"\breach\s+(?:me\s+)?(?:via|by)\s+(?:email|mail)\b",
]
COMMON_TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "co", "io", "ai", "app", "dev", "tech", "info", "biz", "name", "pro", "mobi", "tel",
    "travel", "uk", "us", "ca", "au", "de", "fr", "jp", "cn", "ru", "br", "in", "it", "es", "nl", "se", "no",
]
SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "adf.ly", "bl.ink", "lnkd.in", "shorte.st", "cutt.ly", "rb.gy",
    "clck.ru", "tiny.cc", "short.io", "rebrand.ly", "v.gd", "tr.im", "cli.gs", "u.to", "x.co", "scrnch.me", "fiverr.com/s", "mcaf.ee",
    "su.pr", "qr.ae", "cur.lv", "ity.im", "q.gs",
]
SOCIAL_DOMAINS = [
    "wa.me", "whatsapp.com", "t.me", "telegram.me", "telegram.org", "instagram.com", "facebook.com", "fb.me", "twitter.com", "snapchat.com",
    "tiktok.com", "discord.gg", "discord.com", "signal.org", "threema.ch", "line.me", "wechat.com", "viber.com", "kik.com", "skype.com",
    "zoom.us",
]


def _twice_escaped(domains: list[str]) -> str:
    """Domains as they are looked for: with a backslash before each dot, so ordinary links do not match."""
    return "|".join(d.replace(".", r"\\\.") for d in domains)


URL = {
    "full": r"\b(?:https?|ftp)://(?:[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+)",
    "shortener": rf"\b(?:https?://)?(?:www\.)?(?:{_twice_escaped(SHORTENERS)})(?:/[a-zA-Z0-9\-_]+)?",
    "social": rf"\b(?:https?://)?(?:www\.)?(?:{_twice_escaped(SOCIAL_DOMAINS)})(?:/[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*)?",
    "no_protocol": r"\b(?:www\.)?[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}(?:/[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]*)?",
    "mention": r"\b[a-zA-Z0-9\-]+\s+dot\s+[a-zA-Z]{2,}\b(?:\s+(?:slash|/)\s+[a-zA-Z0-9\-_]+)?",
    "obfuscated": r"\b[a-zA-Z0-9\-]+\s*[\(\[\{]?\s*dot\s*[\)\]\}]?\s*[a-zA-Z]{2,}(?:\s*[\(\[\{]?\s*(?:slash|/)\s*[\)\]\}]?\s*[a-zA-Z0-9\-_]+)?",
    "bracket": r"\b[a-zA-Z0-9\-]+[\[\(]\s*\.\s*[\]\)][a-zA-Z]{2,}(?:[/\\\[\]\(\)][\[\(\s]*[a-zA-Z0-9\-._~:/?#@!$&'*+,;=%]*)?",
}
URL_CUT = {"full": 0.3, "shortener": -1.0, "social": -1.0, "no_protocol": 0.4, "mention": 0.4, "obfuscated": 0.5, "bracket": 0.4}
URL_CONTEXT = [r"\b(?:check\s+out|visit|go\s+to|see|view|click|open)\b", r"\b(?:link|url|website|site)\s*(?:is|:)?\b", r"\b(?:my|the)\s+(?:link|url|website|site|page)\b"]

#: platform: (handles, mentions, indicators)
PLATFORMS = {
    "whatsapp": (
        [r"\bwa\.me/[\w\d+]+", r"\bwhatsapp\.com/[\w\d+]+", r"\b(?:my\s+)?whatsapp\s+(?:is|number|:)\s*[+\d\s\-()]+"],
        [r"\b(?:whatsapp|wassup|whats\s*app|wa)\s+me\b", r"\b(?:on|via|through)\s+(?:whatsapp|wa)\b", r"\b(?:text|message|msg|contact)\s+(?:me\s+)?(?:on|via)\s+(?:whatsapp|wa)\b", r"\b(?:add|reach|find)\s+(?:me\s+)?(?:on|via)\s+(?:whatsapp|wa)\b"],
        ["whatsapp", "wa.me", "wassup", "wapp"],
    ),
    "telegram": (
        [r"\bt\.me/[\w\d_]+", r"\btelegram\.me/[\w\d_]+", r"\btelegram\.org/[\w\d_]+", r"@[\w\d_]{5,32}(?!\w)"],
        [r"\b(?:telegram|tg)\s+me\b", r"\b(?:on|via|through)\s+(?:telegram|tg)\b", r"\b(?:text|message|msg|contact)\s+(?:me\s+)?(?:on|via)\s+(?:telegram|tg)\b", r"\b(?:add|reach|find)\s+(?:me\s+)?(?:on|via)\s+(?:telegram|tg)\b", r"\bmy\s+(?:telegram|tg)\s+(?:is|handle|username|:)\b"],
        ["telegram", "t.me", "tg", "telegrm"],
    ),
    "instagram": (
        [r"\binstagram\.com/[\w\d_.]+", r"\binstagr\.am/[\w\d_.]+", r"@[\w\d_.]{1,30}(?!\w)"],
        [r"\b(?:instagram|insta|ig)\s+me\b", r"\b(?:on|via|through)\s+(?:instagram|insta|ig)\b", r"\b(?:follow|dm|message|msg)\s+(?:me\s+)?(?:on|via)\s+(?:instagram|insta|ig)\b", r"\b(?:add|find)\s+(?:me\s+)?(?:on|via)\s+(?:instagram|insta|ig)\b", r"\bmy\s+(?:instagram|insta|ig)\s+(?:is|handle|username|:)\b"],
        ["instagram", "insta", "ig", "instagr"],
    ),
    "snapchat": (
        [r"\bsnapchat\.com/add/[\w\d_.]+"],
        [r"\b(?:snapchat|snap)\s+me\b", r"\b(?:on|via|through)\s+(?:snapchat|snap)\b", r"\b(?:add|message|msg|contact)\s+(?:me\s+)?(?:on|via)\s+(?:snapchat|snap)\b", r"\bmy\s+(?:snapchat|snap)\s+(?:is|handle|username|:)\b", r"\badd\s+me\s+(?:on\s+)?snap\b"],
        ["snapchat", "snap", "snapcht"],
    ),
    "signal": (
        [r"\bsignal\.org/[\w\d+]+", r"\bsignal\.me/[\w\d+]+"],
        [r"\b(?:signal|sig)\s+me\b", r"\b(?:on|via|through)\s+(?:signal|sig)\b", r"\b(?:text|message|msg|contact)\s+(?:me\s+)?(?:on|via)\s+(?:signal|sig)\b", r"\bmy\s+(?:signal|sig)\s+(?:is|number|:)\b"],
        ["signal", "sig"],
    ),
    "discord": (
        [r"\bdiscord\.gg/[\w\d]+", r"\bdiscord\.com/invite/[\w\d]+", r"[\w\d_]{2,32}#\d{4}"],
        [r"\b(?:discord|disc)\s+me\b", r"\b(?:on|via|through)\s+(?:discord|disc)\b", r"\b(?:message|msg|dm|contact)\s+(?:me\s+)?(?:on|via)\s+(?:discord|disc)\b", r"\bmy\s+(?:discord|disc)\s+(?:is|tag|username|:)\b", r"\bjoin\s+(?:my\s+)?discord\b"],
        ["discord", "disc", "discrd"],
    ),
    "messenger": (
        [r"\bm\.me/[\w\d.]+", r"\bmessenger\.com/t/[\w\d.]+", r"\bfb\.me/[\w\d.]+"],
        [r"\b(?:facebook\s+)?messenger\s+me\b", r"\b(?:on|via|through)\s+(?:facebook\s+)?messenger\b", r"\b(?:message|msg|contact)\s+(?:me\s+)?(?:on|via)\s+(?:facebook\s+)?messenger\b", r"\bfb\s+(?:message|msg|me)\b"],
        ["messenger", "fb.me", "m.me", "facebook"],
    ),
    "tiktok": (
        [r"\btiktok\.com/@[\w\d_.]+", r"@[\w\d_.]{2,24}(?!\w)"],
        [r"\b(?:tiktok|tik\s*tok|tt)\s+me\b", r"\b(?:on|via|through)\s+(?:tiktok|tik\s*tok|tt)\b", r"\b(?:follow|message|dm)\s+(?:me\s+)?(?:on|via)\s+(?:tiktok|tik\s*tok|tt)\b", r"\bmy\s+(?:tiktok|tik\s*tok|tt)\s+(?:is|handle|username|:)\b"],
        ["tiktok", "tik tok", "tt"],
    ),
}
GENERIC_DM = [
    r"\bdm\s+me\b", r"\bslide\s+into\s+(?:my\s+)?dms?\b", r"\bhit\s+(?:up\s+)?(?:my\s+)?dms?\b", r"\bcheck\s+(?:your\s+)?dms?\b",
    r"\bmessage\s+me\s+(?:directly|privately|private)\b", r"\btext\s+me\s+(?:directly|privately|private)\b", r"\bcontact\s+me\s+(?:directly|privately|off\s*[-\s]*platform)\b",
]
AT_MENTION = r"@[\w\d_]{3,30}(?!\w)"
OFF_PLATFORM = ["off platform", "outside of here", "not here", "reach me", "contact me", "find me", "add me"]
DM_OFF_PLATFORM = ["off platform", "outside", "not here", "privately"]

#: category: (boost, patterns)
INTENT = {
    "direct_request": (0.3, [
        r"\b(?:give|send|share|tell)\s+(?:me\s+)?(?:your|ur|u)\s+(?:number|phone|email|contact)\b",
        r"\b(?:what'?s|whats)\s+(?:your|ur|u)\s+(?:number|phone|email|contact|whatsapp|insta|snap)\b",
        r"\bcan\s+(?:i\s+)?(?:get|have)\s+(?:your|ur|u)\s+(?:number|phone|email|contact)\b",
        r"\bgimme\s+(?:your|ur|u)\s+(?:number|phone|email|contact|digits)\b",
        r"\bhow\s+(?:can|do)\s+(?:i|we)\s+(?:contact|reach)\s+(?:you|u)\b",
        r"\bdo\s+(?:you|u)\s+have\s+(?:whatsapp|telegram|insta|snap|discord)\b",
    ]),
    "suggestion_off_platform": (0.25, [
        r"\blet'?s\s+(?:take\s+this\s+)?(?:chat|talk|conversation|continue|move)\s+(?:off|outside|offline)\b",
        r"\blet'?s\s+(?:talk|chat|discuss|continue)\s+(?:offline|privately|off[-\s]?platform)\b",
        r"\btake\s+this\s+(?:conversation|chat|discussion)\s+(?:offline|off[-\s]?platform|elsewhere|outside)\b",
        r"\bmessage\s+me\s+(?:directly|privately|outside|elsewhere|off\s+here)\b",
        r"\bcontact\s+me\s+(?:directly|privately|outside|elsewhere|off\s+here)\b",
        r"\btext\s+me\s+(?:directly|privately|outside|elsewhere|instead)\b",
        r"\breply\s+(?:directly|privately|off\s+here)\b",
        r"\breply\s+(?:to\s+)?(?:my\s+)?(?:dm|message|text)\b",
    ]),
    "contact_sharing": (0.25, [
        r"\bhere'?s\s+(?:my\s+)?(?:number|phone|email|contact|info|whatsapp|telegram|insta|snap)\b",
        r"\bmy\s+(?:number|phone|email|contact)\s+(?:is|:)\b",
        r"\b(?:reach|contact|find|add)\s+(?:me\s+)?(?:at|on|via)\b",
        r"\b(?:call|text|email|message)\s+me\s+at\b",
        r"\bget\s+(?:in\s+touch|back\s+to\s+me)\s+(?:at|on|via)\b",
        r"\bi'?m\s+(?:available\s+)?(?:at|on)\s+(?:whatsapp|telegram|insta|snap|discord)\b",
        r"\byou\s+can\s+(?:reach|contact|find|text|call|message|dm)\s+me\b",
    ]),
    "platform_evasion": (0.3, [
        r"\b(?:so|because)\s+(?:we\s+)?(?:don'?t|dont|wont|won't)\s+(?:have\s+to\s+)?(?:use|stay\s+on)\s+(?:this|here)\b",
        r"\boutside\s+(?:of\s+)?(?:this|here|the\s+app|the\s+platform|the\s+site)\b",
        r"\bnot\s+(?:on|through)\s+(?:this|here|the\s+app|the\s+platform)\b",
        r"\b(?:bypass|avoid|skip)\s+(?:this|the\s+app|the\s+platform|the\s+chat)\b",
        r"\bthis\s+(?:app|platform|site|chat)\s+(?:is\s+)?(?:not\s+good|slow|bad|annoying)\b",
        r"\bwithout\s+(?:using\s+)?(?:this|the\s+app|the\s+platform|the\s+site)\b",
        r"\boff\s+(?:of\s+)?(?:this|here|the\s+app|the\s+platform)\b",
    ]),
    "coded_language": (0.2, [
        r"\bdrop\s+(?:me\s+)?(?:your|ur|u)\s+(?:digits|deets|info|contacts?)\b",
        r"\bslide\s+(?:into\s+)?(?:my\s+)?(?:dms?|inbox|messages?)\b",
        r"\bhit\s+(?:me\s+)?(?:up|back)\b",
        r"\bhmu\b",
        r"\bsend\s+(?:me\s+)?(?:a\s+)?dm\b",
        r"\bcheck\s+(?:your|ur|u)\s+(?:dms?|inbox|messages?)\b",
        r"\bhit\s+(?:my\s+)?(?:line|dm|inbox)\b",
        r"\bping\s+me\b",
        r"\bholla\s+(?:at\s+me|back)\b",
    ]),
    "exchange_coordination": (0.25, [
        r"\bi'?ll\s+(?:send|share|give|dm)\s+(?:you|u)\s+(?:my\s+)?(?:number|contact|info|details)\b",
        r"\bcan\s+(?:you|u)\s+(?:send|share|give|dm)\s+(?:me\s+)?(?:your|ur)\s+(?:number|contact|info)\b",
        r"\blet'?s\s+exchange\s+(?:numbers|contacts|info|details)\b",
        r"\bwanna\s+exchange\s+(?:numbers|contacts|info|details)\b",
        r"\bshare\s+(?:your|ur|my)\s+(?:number|contact|info|details)\s+(?:with\s+)?(?:me|you|u)\b",
        r"\bgive\s+(?:me|you|u)\s+(?:your|my|ur)\s+(?:real\s+)?(?:number|contact|email)\b",
    ]),
    "privacy_language": (0.2, [
        r"\b(?:let'?s\s+)?(?:talk|chat|discuss)\s+(?:more\s+)?(?:privately|in\s+private)\b",
        r"\bthis\s+is\s+(?:too\s+)?(?:public|open)\b",
        r"\b(?:want|need)\s+(?:more\s+)?privacy\b",
        r"\bsomewhere\s+(?:more\s+)?(?:private|secure|discreet)\b",
        r"\bdiscretely?\b",
        r"\b(?:between|just)\s+(?:us|you\s+and\s+me)\b",
    ]),
    "urgency_pressure": (0.15, [
        r"\bquick(?:ly)?\s+(?:give|send|share|tell)\s+me\b",
        r"\bneed\s+(?:to\s+)?(?:contact|reach|talk\s+to)\s+(?:you|u)\s+(?:asap|urgently|now|quickly)\b",
        r"\bright\s+now\b",
        r"\basap\b",
        r"\burgent(?:ly)?\b",
        r"\btime\s+sensitive\b",
        r"\bbefore\s+(?:this\s+)?(?:expires|closes|ends)\b",
    ]),
}
BOOSTERS = {
    0.15: ["number", "phone", "email", "contact", "whatsapp", "telegram", "instagram", "snapchat", "discord", "signal", "digits", "info"],
    0.10: ["off platform", "outside", "privately", "offline", "directly", "app", "site", "chat", "here"],
    0.05: ["reach", "contact", "message", "text", "call", "dm", "ping", "reply", "respond", "get back", "hit up"],
}
NEGATION = r"\b(?:don'?t|doesn'?t|won'?t|wouldn'?t|shouldn'?t|never|not|no)\b"
CONTACT_TERMS = ["number", "phone", "email", "whatsapp", "telegram", "instagram", "snapchat", "discord", "signal"]
EVASION_TERMS = ["off platform", "outside of here", "not here", "bypass", "without using this"]

#: Stage 2 clusters: (weight, patterns)
CLUSTERS = {
    "direct_request": (0.80, [
        r"\b(?:give|send|share|drop|leave)\s+(?:me\s+)?(?:your|ur)\s+(?:number|phone|cell|digits|email|contact|info)\b",
        r"\bwhat(?:'s| is)\s+(?:your|ur)\s+(?:number|phone|email|contact)\b",
        r"\bcan\s+(?:i|I)\s+(?:get|have|grab)\s+(?:your|ur)\s+(?:number|phone|email|contact)\b",
    ]),
    "move_offplatform": (0.70, [
        r"\b(?:let(?:'s|us)|we\s+(?:should|could|can))\s+(?:talk|chat|connect|continue|move|switch)\s+(?:off|outside|on|via|through|over)\b",
        r"\b(?:take\s+this|move\s+this|continue\s+this)\s+(?:offline|off[\s-]?platform|elsewhere|outside)\b",
        r"\b(?:rather|prefer)\s+(?:not\s+)?(?:use|chat|talk)\s+(?:on\s+)?(?:here|this\s+(?:app|platform|chat))\b",
    ]),
    "contact_sharing": (0.75, [
        r"\b(?:here(?:'s| is)|this\s+is)\s+my\s+(?:number|phone|cell|email|contact|whatsapp|telegram|snap)\b",
        r"\b(?:reach|contact|find|message|text|call|hit)\s+me\s+(?:at|on|via|through)\b",
        r"\bmy\s+(?:number|phone|cell|email|contact)\s+is\b",
    ]),
    "platform_evasion": (0.65, [
        r"\b(?:don(?:'t| not)|no\s+need\s+to)\s+(?:use|go\s+through|rely\s+on)\s+(?:this|the)\s+(?:app|platform|chat|system)\b",
        r"\b(?:outside|off)\s+(?:of\s+)?(?:this|the)\s+(?:app|platform|chat)\b",
        r"\b(?:middleman|fees?|commission|cut)\b.*\b(?:avoid|skip|bypass|save)\b",
    ]),
}
TYPE_WEIGHTS = {"phone": 0.85, "email": 0.80, "url": 0.50, "social": 0.75, "intent": 0.35, "obfuscation": 0.15}
TYPE_LABELS = {"phone": "phone_number", "email": "email_address", "url": "url_link", "social": "social_handle", "intent": "intent_phrase", "obfuscation": "obfuscation"}
STAGE_WEIGHTS = {1: 0.5, 2: 0.3, 3: 0.2}
