"""Error codes with their exit status; fixed values."""

EXIT = {
    "E_INVALID_ARGUMENT": 2, "E_INVALID_IMAGE": 2, "E_LIMIT_EXCEEDED": 2, "E_INVALID_CURSOR": 2,
    "E_NOT_FOUND": 3, "E_STORE_NOT_INITIALIZED": 3, "E_UNSUPPORTED_IMAGE": 3, "E_UNSUPPORTED_METADATA": 3, "E_CODEC_UNAVAILABLE": 3, "E_SOURCE_NOT_RETAINED": 3,
    "E_CONFLICT": 4, "E_BUSY": 4, "E_OUTPUT_EXISTS": 4, "E_SOURCE_CHANGED": 4, "E_MIGRATION_INCOMPLETE": 4,
    "E_INTEGRITY": 5, "E_SCHEMA_VERSION": 5, "E_STORE_MISMATCH": 5,
    "E_CODEC_FAILURE": 6, "E_IO": 6, "E_PERMISSION": 6, "E_DISK_FULL": 6,
}
RETRYABLE = {"E_BUSY", "E_SOURCE_CHANGED"}


class LedgerError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.exit = code, EXIT.get(code, 6)
        self.retryable = code in RETRYABLE
