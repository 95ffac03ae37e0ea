"""Word lists, label maps, thresholds and patterns.

Everything in this module is data whose exact content decides a result; the
logic that uses it lives elsewhere.
"""

# City names; list order is match priority.
CITIES = [
    "臺北市", "新北市", "基隆市", "桃園市", "新竹市", "新竹縣", "苗栗縣", "臺中市",
    "彰化縣", "南投縣", "雲林縣", "嘉義市", "嘉義縣", "臺南市", "高雄市", "屏東縣",
    "宜蘭縣", "花蓮縣", "臺東縣", "澎湖縣", "金門縣", "連江縣",
]
# Abbreviated city names accepted at the start of a token.
SHORT_CITIES = {
    "北市": "臺北市", "新北": "新北市", "桃市": "桃園市",
    "中市": "臺中市", "南市": "臺南市", "高市": "高雄市",
}
REGION_UNKNOWN = "地區未提供"
REGION_UNANNOUNCED = "地區未公布"
VENUE_UNANNOUNCED = "場館未公布"
VENUE_PLACEHOLDERS = ["場館未提供", "unknown", ""]

# Ticket host -> platform label.
PLATFORM_HOSTS = {
    "kktix.com": "KKTIX",
    "www.kktix.com": "KKTIX",
    "tixcraft.com": "拓元 tixCraft",
    "ticket.com.tw": "年代 ERA",
    "kham.com.tw": "寬宏 KHAM",
    "ticket.ibon.com.tw": "ibon",
    "www.opentix.life": "OPENTIX",
    "opentix.life": "OPENTIX",
}
# Two further hosts known only while reading detail pages.
DETAIL_PLATFORM_HOSTS = {
    "ticketplus.com.tw": "遠大 Ticket Plus",
    "ticket.mna.com.tw": "寬宏 KHAM",
}
PLATFORM_SUFFIXES = {".kktix.cc": "KKTIX"}

# Host -> source id of a batch row.
SOURCE_HOSTS = {
    "tixcraft.com": "tixcraft",
    "kham.com.tw": "kham",
    "ticket.ibon.com.tw": "ibon",
    "ticket.com.tw": "era",
    "www.opentix.life": "opentix",
    "opentix.life": "opentix",
    "comedyclub.kktix.cc": "comedyclub",
    "www.arena.taipei": "taipei-arena",
    "www.tmc.taipei": "tmc",
    "www.accupass.com": "accupass",
    "kktix.com": "kktix",
    "www.kktix.com": "kktix",
}
SOURCE_SUFFIXES = {".kktix.cc": "kktix"}

# Topic names and the provider category code of each.
KIND_CATEGORY = {"concerts": "17", "comedy": "11"}
EXHIBITION_CATEGORY = "6"

# Classifier patterns, tested in this order.
COURSE_PATTERN = (
    r"課程|工作坊|研習|研討會|講座|音樂劇|音樂喜劇|歌劇(?!院)|\bopera\b|musical|workshop|masterclass|\bcourse\b|\bclass\b"
)
FAN_MEETING_PATTERN = r"fan.?meeting|粉絲見面|見面會|票券升級|\bupgrade\b"
OTHER_FORMAT_PATTERN = (
    r"相聲|漫才|魔術|親子劇|即興劇|即興喜劇|喜劇小品|\bimprov\b|\bsketch\b|\btheat(?:re|er)\b"
)
STANDUP_PATTERN = r"脫口秀|單口喜劇|站立喜劇|stand[ -]?up|\bcomedy\b"
CONCERT_PATTERN = r"演唱會|音樂會|演唱|\bconcert\b|\blive\b"
EVIDENCE_FIELDS = [
    "title", "format", "categories", "description", "performers", "showUnit", "descriptionFilterHtml",
]

# Genre rules; the first matching rule names the genre.
GENRE_RULES = [
    ("爵士", r"爵士|\bjazz\b"),
    ("合唱／聲樂", r"合唱|唱詩|聖歌|聲樂|獨唱會|女高音|男高音|次女高音|美聲|a\s?cappella|阿卡貝拉|\bchoir\b|\bchorus\b|\bvocal ensemble\b"),
    ("國樂／傳統", r"國樂|絲竹|南管|北管|二胡|琵琶|古箏|古琴|揚琴|笙|嗩吶|笛韻|竹笛|胡琴|客家八音|戲曲音樂|(?-i:(?<![A-Za-z])TCO(?![A-Za-z]))|\bchinese orchestra\b"),
    ("管樂", r"管樂|軍樂|陸軍樂隊|海軍樂隊|空軍樂隊|\bwind (?:band|ensemble|orchestra)\b|\bbrass\b"),
    ("古典／室內樂", r"交響|管弦|室內樂|獨奏會|協奏|奏鳴|愛樂|弦樂|絃樂|四重奏|三重奏|二重奏|擊樂|鋼琴|小提琴|中提琴|大提琴|管風琴|長笛|豎琴|指揮|莫札特|貝多芬|巴赫|蕭邦|布拉姆斯|柴可夫斯基|馬勒|德布西|拉赫曼尼諾夫|舒伯特|海頓|韋瓦第|(?-i:(?<![A-Za-z])[A-Z]{1,3}SO(?![A-Za-z]))|\bsymphon|\bphilharmon|\borchestra\b|\brecital\b|\bquartet\b|\bpiano\b|\bviolin\b|\bcello\b|\borgan\b"),
    ("流行／搖滾演唱會", r"演唱會|巡迴|巡演|\btour\b|\blive\b|\bconcert\b|fan ?con|\bfestival\b|音樂節|專場|演出會"),
]
GENRE_OTHER = "其他音樂會"
GENRE_DEFAULT = "流行／搖滾演唱會"
# Display order of genres; anything else sorts as 99.
GENRE_ORDER = [
    "流行／搖滾演唱會", "古典／室內樂", "國樂／傳統", "合唱／聲樂", "爵士", "管樂", "其他音樂會",
]

# Status enumerations.
EVENT_STATUSES = ["scheduled", "changed", "unconfirmed", "cancelled", "rescheduled"]
VENUE_STATUSES = ["named", "address", "missing", "uncertain", "online"]

# Default texts.
SUMMARY_DEFAULT = "官方活動基本資料；詳細規定請見來源。"
SALE_NOTE_DEFAULT = "一般開賣時間未提供，請見官方。"
TICKET_STATUS_DEFAULT = "非即時票況"
PRICE_FREE = "免費"
PRICE_UNKNOWN = "未提供，請洽官方"
PRICE_MIXED = "各場次票價不同，請見官方資訊"
UNVERIFIED_PLATFORM = "未核對"
SALE_CONFLICT_TEXT = "開賣資料矛盾，待官方確認"
SALE_CONFLICT_PATTERN = r"一般開賣[^。；]*(?:未公布|未提供)"
NOTE_CHANGED = "來源場次日期或時間異動，請確認官方公告。"
NOTE_STATUS_CHANGED = "來源日期／時間已變更，是否正式改期請確認官方公告。"
NOTE_REVIEWED_CHANGED = "已核對來源場次異動。"
NOTE_UNCONFIRMED = "來源本次未列出，保留原資料；不代表取消，請向官方確認。"
NOTE_NOT_LISTED = "本次已核對範圍未列出；保留資料，不據此認定取消。"
START_UNKNOWN = "開始日期待確認"
END_UNKNOWN = "結束日期待確認"

# Listing badges in ladder order.
BADGE_NOTE = "狀態待確認"
BADGE_ENDED = "已結束"
BADGE_UNKNOWN = "展期待確認"
BADGE_UPCOMING = "即將開展"
BADGE_ENDING = "即將結束"
BADGE_RUNNING = "展期內"

# Source state labels.
STATE_DAILY = "每日自動更新"
STATE_DONE = "本次處理完成"
STATE_MANUAL = "人工維護"
STATE_PENDING = "尚待來源核對"
STATE_FAILED = "更新失敗／保留舊資料"

# Park detection, tested in this order, and park display names.
PARK_PATTERNS = [("songshan", "松山文創|松菸|松煙"), ("huashan", "華山"), ("pier2", "駁二")]
PARK_NAMES = {"songshan": "松山文創園區", "huashan": "華山1914", "pier2": "駁二藝術特區"}
PARK_REGION = {"songshan": "臺北市", "huashan": "臺北市", "pier2": "高雄市"}

# Venue name aliases (pattern or prefix -> grouping name).
VENUE_ROOM_PATTERNS = [
    (r"^府中15\s*\d+F", "府中15"),
    (r"^新浜碼頭藝術空間\s*\d+F", "新浜碼頭藝術空間"),
    (r"^富興工廠1962\s*\d+F", "富興工廠1962"),
    (r"^佛光山佛陀紀念館 ", "佛光山佛陀紀念館"),
    (r"^國立臺灣科學教育館 ", "國立臺灣科學教育館"),
    (r"^中正紀念堂\d+展廳", "中正紀念堂"),
]
VENUE_EXACT = {"臺南市奇美博物館": "奇美博物館", "基隆文化中心": "基隆市文化中心"}
VENUE_KING_CAR = "金車文藝中心承德館"
VENUE_KING_CAR_STREET = "承德路三段131號"
VENUE_ONLINE = "線上展覽（無實體展出場館）"
VENUE_MISSING = "地點未提供"

# Program identity rules.
PROGRAM_RULES = [
    ("lan-all-around-you", "藍恩", "all around you"),
    ("coldn-after-cut", "涵冷娜", "喊卡之後"),
]

# Provenance of a listing link.
DATASET_URL = "https://data.gov.tw/dataset/6012"
DATASET_MARK = "data.gov.tw/dataset/"
CULTURE_HOST = "cloud.culture.tw"
CULTURE_PATH = "/frontsite/inquiry/eventInquiryAction.do"

# Guard limits.
REJECT_RATIO = 0.2
LOSS_RATIO = 0.5
LOSS_MIN_ACTIVE = 20
DAILY_PAGE_BUDGET = 100
RECHECK_LIMIT = 3
STALE_HOURS = 36
PAGE_SIZE = 24

# Item messages allowed to leave a run; others become one code.
ITEM_REASONS = ["two explicit dates required", "reversed dates", "missing title or venue"]
GENERIC_REASON = "VALIDATION_ERROR"

# Leak patterns (Java and RE2 read them alike).
LEAK_PATTERNS = {
    "email": r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    "token": r"(?i)(?:gh[pousr]_[a-z0-9]{20,}|github_pat_|sk-proj-)",
    "private_key": r"(?i)-----BEGIN .*PRIVATE KEY",
    "local_path": r"(?i)[a-z]:[\\/]+Users[\\/]",
    "forbidden_field": r"(?i)(?:descriptionFilterHtml|imageURL|posterURL)",
}
# Lower-case literals of which every match of a leak pattern holds one.
LEAK_GATES = {
    "email": ["@"],
    "token": ["_", "sk-proj-"],
    "private_key": ["-----"],
    "local_path": [":/", ":\\"],
    "forbidden_field": ["descriptionfilterhtml", "imageurl", "posterurl"],
}

# Calendar session fields and labels, race name -> slug.
CALENDAR_FIELDS = [
    ("FirstPractice", "Practice 1"), ("SecondPractice", "Practice 2"), ("ThirdPractice", "Practice 3"),
    ("SprintQualifying", "Sprint Qualifying"), ("Sprint", "Sprint"), ("Qualifying", "Qualifying"),
]
SESSION_LABELS = {
    "Practice 1": "練習 1", "Practice 2": "練習 2", "Practice 3": "練習 3",
    "Sprint Qualifying": "衝刺排位", "Sprint": "衝刺", "Qualifying": "排位", "Race": "正賽",
}
RACE_SLUGS = {
    "Australian": "australia", "Chinese": "china", "Japanese": "japan", "Miami": "miami",
    "Canadian": "canada", "Monaco": "monaco", "Barcelona": "barcelona-catalunya",
    "Austrian": "austria", "British": "great-britain", "Belgian": "belgium",
    "Hungarian": "hungary", "Dutch": "netherlands", "Italian": "italy", "Spanish": "spain",
    "Azerbaijan": "azerbaijan", "Bahrain Grand Prix in Malaysia": "bahrain",
    "Singapore": "singapore", "United States": "united-states", "Mexico City": "mexico",
    "Brazilian": "brazil", "Las Vegas": "las-vegas", "Qatar": "qatar",
    "Abu Dhabi": "united-arab-emirates",
}

# Opening words that leave a period open-ended.
OPEN_ENDED_PATTERN = r"起|常設|長期|未定|持續|迄今"
# List tags that may need a detail page.
CONCERT_TAG = "演唱會"
DETAIL_TAGS = ["演唱會", "中心自辦", "中心合辦"]

# Price texts of detail pages.
DETAIL_FREE = "免費（仍請確認官方參加條件）"
DETAIL_PAID = "付費，詳細票價請查官方"
DETAIL_UNKNOWN = "官網未提供結構化票價，請查官方"
DETAIL_UNCHECKED = "票價未逐日確認；"
DETAIL_LAST_REVIEW = "票價未逐日確認；前次人工核對："

# The label of a list of dates, the labels that end it, its dates and its clocks.
DATES_LABEL = "活動日期"
DATES_END = r"主辦單位|聯絡電話|票\s*價"
BARE_DATE = r"\d{4}\s*/\s*\d{1,2}\s*(?:/|月)\s*\d{1,2}日?"
START_CLOCK = r"(\d{1,2}:\d{2})\s*開演"
PLAIN_CLOCK = r"(\d{1,2}:\d{2})(?!\d|\s*開場)"
