"""Word lists and constants that must be exactly these for right results."""

# Tag key -> synonyms.
TAG_SYNONYMS = {
    "portrait": ["肖像", "ポートレート", "プロフィール写真"],
    "selfie": ["自撮り", "セルフポートレート", "セルフショット"],
    "person": ["人", "人物", "ヒト", "individual"],
    "face": ["顔", "表情", "フェイス", "visage"],
    "people": ["人々", "集団", "folks", "crowd"],
    "human": ["人間", "ホト", "mankind", "人類"],
    "model": ["モデル", "モデリング", "mannequin", "ポーザー"],
    "cosplay": ["コスプレ", "costume play", "仮装", "character dress"],
    "celebrity": ["セレブ", "有名人", "スター", "famous person"],
    "influencer": ["インフルエンサー", "影響力のある人", "social media star"],
    "actor": ["俳優", "演技者", "performer", "artiste"],
    "actress": ["女優", "女性演技者", "female performer"],
    "musician": ["音楽家", "ミュージシャン", "artist", "演奏家"],
    "artist": ["アーティスト", "芸術家", "creator", "表現者"],
    "performer": ["パフォーマー", "実演家", "entertainer", "舞台人"],
    "dancer": ["ダンサー", "踊り手", "choreographer", "舞踊家"],
    "smile": ["笑顔", "スマイル", "微笑", "grin"],
    "laugh": ["笑う", "笑い", "chuckle", "giggle"],
    "pose": ["ポーズ", "姿勢", "stance", "posture"],
    "expression": ["表情", "感情表現", "facial expression", "look"],
    "emotion": ["感情", "気持ち", "sentiment", "feeling"],
    "nsfw": ["エロ", "不適切", "センシティブ", "mature content"],
    "adult": ["アダルト", "成人向け", "mature", "18禁"],
    "sexy": ["セクシー", "エロティック", "provocative", "官能的"],
    "nude": ["ヌード", "裸", "bare", "undressed"],
    "provocative": ["挑発的", "センシティブ", "suggestive", "risqué"],
}

# Vocabularies of the tag classifier.
PERSON_TAGS = [
    "portrait", "selfie", "person", "face", "people", "human", "model",
    "cosplay", "celebrity", "influencer", "actor", "actress",
    "musician", "artist", "performer", "dancer",
    "smile", "laugh", "pose", "expression", "emotion",
]
NSFW_TAGS = ["nsfw", "adult", "sexy", "nude", "provocative"]

# Label words that mark a prediction as unsafe.
NSFW_LABEL_WORDS = ["nude", "lingerie", "bikini", "underwear"]

# Style classes, in class-index order.
STYLE_LABELS = [
    "anime", "photorealistic", "illustration", "digital_art", "watercolor",
    "sketch", "pixel_art", "comic", "abstract", "minimalist",
]

# File extensions listed, formats accepted, and the limits of the validity check.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "webp"]
ORGANIZE_EXTENSIONS = ["png", "jpg", "jpeg", "bmp", "gif"]
VALID_FORMATS = ["jpg", "jpeg", "png", "gif", "webp"]
MAX_FILE_BYTES = 10 * 1024 * 1024
MIN_SIDE = 500
MIN_RATIO, MAX_RATIO = 0.5, 2.0
MIN_COLOR_RATIO = 0.1
MIN_BLUR_VARIANCE = 50.0

# Colour names used for tag recommendation (our own table).
COLOR_NAMES = {
    "black": (0, 0, 0), "white": (255, 255, 255), "gray": (128, 128, 128),
    "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255),
    "yellow": (255, 255, 0), "orange": (255, 165, 0), "purple": (128, 0, 128),
    "pink": (255, 192, 203), "brown": (139, 69, 19), "cyan": (0, 255, 255),
}
