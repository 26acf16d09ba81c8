"""Constant dimensions of file formats: names, signatures and extension sets."""

from __future__ import annotations

# Each must equal the established list for results to agree.

#: Extension to display name.
FORMAT_NAMES = {
    ".pdf": "PDF", ".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG", ".gif": "GIF", ".bmp": "BMP", ".tiff": "TIFF", ".tif": "TIFF", ".webp": "WebP", ".ico":
    "ICO", ".zip": "ZIP", ".jar": "JAR", ".apk": "APK", ".docx": "DOCX", ".xlsx": "XLSX", ".pptx": "PPTX", ".odt": "ODT", ".ods": "ODS", ".doc": "DOC",
    ".xls": "XLS", ".ppt": "PPT", ".exe": "PE", ".dll": "PE", ".elf": "ELF", ".so": "ELF", ".mp4": "MP4", ".mov": "MOV", ".mkv": "Matroska", ".webm":
    "WebM", ".avi": "AVI", ".mp3": "MP3", ".wav": "WAV", ".flac": "FLAC", ".ogg": "OGG", ".opus": "Opus", ".aac": "AAC", ".m4a": "M4A", ".txt": "Text",
    ".csv": "CSV", ".json": "JSON", ".xml": "XML", ".md": "Markdown", ".log": "Log", ".gz": "GZip", ".bz2": "BZip2", ".xz": "XZ", ".zst": "Zstandard",
    ".7z": "7-Zip", ".rar": "RAR", ".tar": "TAR", ".sqlite": "SQLite", ".sqlite3": "SQLite", ".db": "SQLite", ".iso": "ISO", ".img": "DiskImage", ".gpg":
    "GnuPG", ".kdbx": "KeePass", ".heic": "HEIC", ".avif": "AVIF",
}

#: Extension to signatures (offset, bytes), any of which is enough.
SIGNATURES = {
    ".png": ((0, b'\x89PNG\r\n\x1a\n'),),
    ".jpg": ((0, b'\xff\xd8\xff'),),
    ".jpeg": ((0, b'\xff\xd8\xff'),),
    ".gif": ((0, b'GIF87a'), (0, b'GIF89a')),
    ".bmp": ((0, b'BM'),),
    ".tiff": ((0, b'II*\x00'), (0, b'MM\x00*')),
    ".tif": ((0, b'II*\x00'), (0, b'MM\x00*')),
    ".webp": ((0, b'RIFF'), (8, b'WEBP')),
    ".ico": ((0, b'\x00\x00\x01\x00'),),
    ".heic": ((4, b'ftypheic'), (4, b'ftypheix'), (4, b'ftypmif1')),
    ".avif": ((4, b'ftypavif'),),
    ".pdf": ((0, b'%PDF-'),),
    ".zip": ((0, b'PK\x03\x04'), (0, b'PK\x05\x06'), (0, b'PK\x07\x08')),
    ".jar": ((0, b'PK\x03\x04'),),
    ".apk": ((0, b'PK\x03\x04'),),
    ".docx": ((0, b'PK\x03\x04'),),
    ".xlsx": ((0, b'PK\x03\x04'),),
    ".pptx": ((0, b'PK\x03\x04'),),
    ".odt": ((0, b'PK\x03\x04'),),
    ".ods": ((0, b'PK\x03\x04'),),
    ".doc": ((0, b'\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1'),),
    ".xls": ((0, b'\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1'),),
    ".ppt": ((0, b'\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1'),),
    ".exe": ((0, b'MZ'),),
    ".dll": ((0, b'MZ'),),
    ".elf": ((0, b'\x7fELF'),),
    ".so": ((0, b'\x7fELF'),),
    ".wav": ((0, b'RIFF'), (8, b'WAVE')),
    ".avi": ((0, b'RIFF'), (8, b'AVI ')),
    ".mkv": ((0, b'\x1aE\xdf\xa3'),),
    ".webm": ((0, b'\x1aE\xdf\xa3'),),
    ".flac": ((0, b'fLaC'),),
    ".ogg": ((0, b'OggS'),),
    ".opus": ((0, b'OggS'),),
    ".mp3": ((0, b'ID3'), (0, b'\xff\xfb'), (0, b'\xff\xf3'), (0, b'\xff\xf2')),
    ".gz": ((0, b'\x1f\x8b'),),
    ".bz2": ((0, b'BZh'),),
    ".xz": ((0, b'\xfd7zXZ\x00'),),
    ".zst": ((0, b'(\xb5/\xfd'),),
    ".7z": ((0, b"7z\xbc\xaf'\x1c"),),
    ".rar": ((0, b'Rar!\x1a\x07\x00'), (0, b'Rar!\x1a\x07\x01\x00')),
    ".sqlite": ((0, b'SQLite format 3\x00'),),
    ".sqlite3": ((0, b'SQLite format 3\x00'),),
    ".db": ((0, b'SQLite format 3\x00'),),
    ".gpg": ((0, b'\x85\x02'), (0, b'\x8c\x03'), (0, b'\x8d\x04')),
    ".kdbx": ((0, b'\x03\xd9\xa2\x9a'), (0, b'\x9a\xa2\xd9\x03')),
}

#: The native analyzer's own table.
NATIVE_SIGNATURES = {
    ".pdf": ((0, b'%PDF'),),
    ".png": ((0, b'\x89PNG\r\n\x1a\n'),),
    ".jpg": ((0, b'\xff\xd8\xff'),),
    ".jpeg": ((0, b'\xff\xd8\xff'),),
    ".gif": ((0, b'GIF87a'), (0, b'GIF89a')),
    ".zip": ((0, b'PK\x03\x04'), (0, b'PK\x05\x06'), (0, b'PK\x07\x08')),
    ".docx": ((0, b'PK\x03\x04'),),
    ".xlsx": ((0, b'PK\x03\x04'),),
    ".gz": ((0, b'\x1f\x8b'),),
    ".bmp": ((0, b'BM'),),
    ".exe": ((0, b'MZ'),),
    ".elf": ((0, b'\x7fELF'),),
    ".mp4": ((4, b'ftyp'),),
}

#: The image header check of the modular strategies; .webp needs all of its signatures.
IMAGE_HEADERS = {
    ".jpg": ((0, b'\xff\xd8\xff'),),
    ".jpeg": ((0, b'\xff\xd8\xff'),),
    ".png": ((0, b'\x89PNG\r\n\x1a\n'),),
    ".gif": ((0, b'GIF87a'), (0, b'GIF89a')),
    ".bmp": ((0, b'BM'),),
    ".webp": ((0, b'RIFF'), (8, b'WEBP')),
}

ISO_BRANDS = [
    "isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "avc1", "dash", "M4V ", "M4A ", "3gp4", "3gp5", "qt  ", "heic", "heix", "mif1", "avif",
]

HIGH_ENTROPY_SAFE = [
    ".zip", ".zipx", ".7z", ".rar", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".zst", ".lz4", ".cab", ".iso", ".img", ".vhd", ".vhdx", ".vmdk", ".qcow2",
    ".docx", ".docm", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odt", ".ods", ".odp", ".jar", ".apk", ".aab", ".war", ".nupkg", ".whl", ".deb", ".rpm",
    ".msi", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic", ".heif", ".avif", ".mp4", ".m4a", ".m4v", ".mov", ".mkv", ".webm", ".avi", ".wmv", ".flv",
    ".mp3", ".aac", ".ogg", ".opus", ".wav", ".flac", ".alac", ".wma", ".gpg", ".pgp", ".age", ".kdbx", ".kdb", ".p12", ".pfx", ".jks", ".keystore",
    ".pem", ".key", ".crt", ".cer", ".der", ".7z.aes", ".hc", ".tc", ".vera", ".pyc", ".pyo", ".class", ".so", ".dll", ".exe", ".bin", ".dat", ".pak",
    ".sqlite", ".sqlite3", ".db", ".mdb", ".torrent", ".pdf", ".ps", ".eps",
]
RANSOMWARE = [
    ".locked", ".locky", ".encrypted", ".enc", ".crypt", ".cipher", ".crypto", ".wncry", ".wcry", ".wncrypt", ".zepto", ".cerber", ".ryk", ".ryuk",
    ".conti", ".lockbit", ".revil", ".phobos", ".djvu", ".stop", ".makop", ".blackcat", ".alphv", ".hive", ".ragnar", ".maze", ".egregor", ".basta",
    ".karma", ".vvv", ".ecc", ".ezz", ".exx", ".pzdc", ".zino", ".bip",
]
TEXT = [
    ".txt", ".log", ".csv", ".json", ".xml", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".toml", ".py", ".js", ".html", ".css", ".md", ".rst",
]
NATIVE_TEXT = [
    ".txt", ".csv", ".json", ".xml", ".yaml", ".yml", ".log", ".md", ".ini", ".toml", ".sql",
]
IMAGE_FAMILY = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".ico",
]
ARCHIVE_FAMILY = [
    ".zip", ".jar", ".apk",
]
ISO_FAMILY = [
    ".mp4", ".m4a", ".m4v", ".mov", ".3gp", ".heic", ".heif", ".avif",
]
MEDIA_FAMILY = [
    ".mp4", ".avi", ".mov", ".mkv", ".mp3", ".wav", ".flac", ".aac", ".ogg", ".webm",
]
