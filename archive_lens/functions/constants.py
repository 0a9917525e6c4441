"""Fixed values of the archive formats: names, patterns and tables that results depend on."""

# Names of files and folders in an export.
RESULT_NAMES = ("result.json", "results.json")
MULTI_ROOT_NAME = "export_results.html"
SINGLE_ROOT_NAME = "messages.html"
DATABASE_NAME = "database.sqlite"
CANONICAL_DIR = ".telegram_backup"
REQUIRED_TABLES = ("messages", "chats", "users")
MARKER_NAME = ".archive_lens_export_meta.json"
MARKER_PATTERN = r"^\.[a-z_]+_export_meta\.json$"

# Folders that hold media, those that are a chat's own, and folders not copied as shared media.
MEDIA_DIRS = ("photos", "files", "video_files", "voice_messages", "audio_files", "documents", "sticker_files", "stickers", "animations", "round_video_messages", "profile_pictures", "images", "media")
CHAT_LOCAL_DIRS = ("photos", "files", "video_files", "voice_messages", "audio_files", "documents", "sticker_files", "stickers", "animations", "round_video_messages", "profile_pictures")
SKIP_SHARED_DIRS = ("css", "js", "images", "profile_pictures", "lists")

# File extensions that are no top-level domains.
FILE_EXTENSIONS = ("7z", "aac", "ai", "apk", "avi", "bat", "bin", "bmp", "csv", "db", "doc", "docx", "dmg", "epub", "exe", "flac", "gif", "gz", "heic", "html", "htm", "iso", "jpeg", "jpg", "js", "json", "m4a", "mkv", "mov", "mp3", "mp4", "ogg", "pdf", "png", "ppt", "pptx", "rar", "rtf", "sqlite", "svg", "tar", "tgz", "tiff", "txt", "wav", "webm", "webp", "xls", "xlsx", "xml", "yaml", "yml", "zip")

# Markers and timestamps of message pages.
MESSAGE_MARK = '<div class="message'
SEPARATOR_MARK = '<div class="message service" id="message-'
DETAILS_MARK = 'class="body details"'
TIMESTAMP = r'<div class="pull_right date details" title="(\d{2})\.(\d{2})\.(\d{4}) (\d{2}):(\d{2}):(\d{2})(?: UTC([+-]\d{2}):(\d{2}))?'
DAY = r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$"
TITLE = r'(?s)<div class="text bold">\s*(.*?)\s*</div>'
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
EXPORT_DATE = r"(?:DataExport|ChatExport)[_-](\d{2})[._-](\d{2})[._-](\d{4})"

# References in pages (Java's regular expressions).
ATTRIBUTE = r"""(?iU)\b(src|href|poster)\s*=\s*(["'])([^"']+)\2"""
ATTRIBUTE_REWRITE = r"""(?iU)\b(src|href)\s*=\s*(["'])([^"']+)\2"""
SRCSET = r"""(?iU)\bsrcset\s*=\s*(["'])([^"']+)\1"""
CSS = r"""(?iU)url\(\s*(["']?)([^"')]+)\1\s*\)"""
LEFTOVER = r"""(?iU)\b(href|src)\s*=\s*(["'])((?:\.\./)+chats/chat_\d+/[^"']+)\2"""
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"

# White space of any kind (the White_Space property of Unicode).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Separators of words alone (Zs), which a title of the test tables is trimmed of.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Units of sizes.
UNITS = {"B": 1, "K": 1024, "KB": 1000, "KiB": 1024, "M": 1024**2, "MB": 1000**2, "MiB": 1024**2, "G": 1024**3, "GB": 1000**3, "GiB": 1024**3, "T": 1024**4, "TB": 1000**4, "TiB": 1024**4, "P": 1024**5, "PB": 1000**5, "PiB": 1024**5}

# Replacements that make a chat's page stand alone, in this order.
STANDALONE = (
    ('href="../../css/', 'href="css/'), ('href="../css/', 'href="css/'),
    ('src="../../js/', 'src="js/'), ('src="../js/', 'src="js/'),
    ('src="../../images/', 'src="images/'), ('href="../../images/', 'href="images/'),
    ('src="../../profile_pictures/', 'src="profile_pictures/'), ('href="../../profile_pictures/', 'href="profile_pictures/'),
    ('href="../../lists/chats.html"', 'href="messages.html"'), ('href="../../lists/chats.html#allow_back"', 'href="messages.html"'),
    ('href="../lists/chats.html"', 'href="messages.html"'), ('href="../lists/chats.html#allow_back"', 'href="messages.html"'),
)
#: Columns that name a row of a users or chats table, in order.
NAME_COLUMNS = ("name", "first_name", "last_name", "title", "username", "phone", "phone_number")
