"""Fixed values that results depend on: labels, markers, limits, alphabets and patterns of the data model."""

# --- fixed values: record fields and ranks ---
SOURCE_RANK = {"meta": 1, "full": 2}
TAG_BOOST = 0.15
EXCERPT_CHARS = 1500
SYNOPSIS_RAW_CHARS = 6000
SYNOPSIS_CHARS = 2500

# --- fixed values: saved-text labels and markers ---
TITLE_LABEL, AUTHOR_LABEL, STATUS_LABEL = "标题：", "作者：", "状态："
UPLOADED_LABEL, CHAPTERS_LABEL, INTEGRITY_LABEL = "上传时间：", "章节数：", "完整性："
SCRAPED_LABEL, SOURCE_LABEL = "抓取时间：", "来源："
PREV_LABEL, NEXT_LABEL = "上一篇：", "下一篇："
COMPLETE = "完整"
NONE_MARK = "—"
DIVIDER = "═"
DIVIDER_MIN, DIVIDER_WIDTH = 10, 40
PAGE_FAILED = "[页面获取失败"
FAILED_TEXT, FAILED_PAGE = "页面获取失败", "[页面获取失败:"
CHAPTER_HEAD = r"^第[零一二三四五六七八九十百千万亿\d]+章"
DATE_YM = r"(\d{4})年(\d{2})月"
DONE, SERIAL = "完结", "连载"

# --- fixed values: response markers ---
BLOCK_MARKERS = ("Just a moment", "cf-browser-verification", "Attention Required")
CONTENT_MARKERS = ("小说简介", "上一篇", "下一篇", "article-content")
#: Paragraphs that hold one of these are advertisements. A site's own names are passed as a parameter.
AD_MARKERS = ("传送门：", "记得收藏网址", "推荐给朋友")

# --- fixed values: tag extraction ---
TAG_SEPARATORS = "[\\s　 、，,/／┃|；;]+"
TAG_CHARS = 12
NOT_TAGS = ("完结", "连载", "番外", "完结+番外", "全文阅读", "最新章节")
NOISE_LINES = ("文案", "简介", "小说简介", "内容简介", "本书简介", "作品简介", "正文", "下载地址")
INTRO_NAMES = ("文案", "小说简介", "简介", "内容简介", "本书简介", "作品简介", "正文")
STOP_LINE = r"开始阅读|阅读记录|^第\d+页第\d+页|^Tips|^上一篇|^下一篇"
TAGS_NAME, KEYWORDS_NAME, ONE_LINER_NAME, INTENT_NAME, TOPIC_NAME = "内容标签", "搜索关键字", "一句话简介", "立意", "所属专题"
KEYWORD_OTHER = r"其[它他][：:]\s*([^┃|]+)"
TITLE_BRACKET = r"[\[【［]([^\]】］]{1,8})[\]】］]"
HEADER_PREFIX = "^\\s*(?:\\[[^\\]]*\\]\\s*)?《[^》]*》\\s*作者[：:][^\\s　 【]*\\s*(?:【[^】]*】)?[\\s　 ]*"
RULE_LINE = r"^[\s\-—─=＝·.。·*※…_~]+$"

# --- fixed values: chapters ---
HEADING_PATTERNS = (
    ("chinese-standard", "Chinese 第…章/回/卷", r"^\s*第[零一二三四五六七八九十百千万亿两〇0-9]+[章回卷节部篇折]\s*.*$"),
    ("english-standard", "English Chapter/Part/Volume", r"^\s*(?:chapter|prologue|epilogue|interlude|part|volume|book|act)\b.{0,98}$"),
)
BLOCK_CHARS, HEADING_CHARS, CHAPTER_CHARS, NUMBER_GAP, FUSED_FACTOR = 2000, 100, 3000, 500, 1.5
CN_DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
PATTERN_CHARS, SAMPLE_CHARS, MAX_EXAMPLES = 240, 100, 20
CHAPTERS_A_PAGE = 120

# --- fixed values: ids ---
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# --- fixed values: file names, tones, windows ---
FS_UNSAFE = r'[\\/:*?"<>|【】\r\n]'
TONES = {"a": "āáǎà", "e": "ēéěè", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔù", "ü": "ǖǘǚǜ"}
WINDOW_COMMIT, WINDOW_LEAD, WINDOW_TRAIL = 150, 30, 60
PROBE_STOP = 4
USER_NAME = r"^[A-Za-z0-9_.-]{3,64}$"
REC_DEPTH = 4
