"""Errors of acquiring and ingesting a repository.  A file's skip reason is the name of its class."""


class RepositoryError(Exception):
    """Acquiring a repository failed."""


class InvalidRepositoryURLError(RepositoryError):
    """The URL's scheme, host or address isn't allowed."""


class InvalidRefError(RepositoryError):
    """A branch or tag name isn't allowed."""


class RepositoryTooLargeError(RepositoryError):
    """More bytes than the limit."""


class CloneTimeoutError(RepositoryError):
    """Cloning took longer than the limit."""


class EmptyRepositoryError(RepositoryError):
    """There is no commit."""


class IngestionError(Exception):
    """Ingesting a file or repository failed."""


class UnsupportedFileExtensionError(IngestionError):
    """No language has the file's extension."""


class FileAccessError(IngestionError):
    """A file's size or content can't be read."""


class LanguageLoadError(IngestionError):
    """A front end can't be loaded."""


class TreeSitterParseError(IngestionError):
    """A front end gave no result for a file; the name is a skip reason of the data model."""


class ChunkExtractionError(IngestionError):
    """A parsed file can't be cut into chunks."""


class UnregisteredLanguageError(ChunkExtractionError):
    """A parsed file's language isn't registered."""


class ChunkDecodeError(ChunkExtractionError):
    """Bytes of a definition aren't UTF-8."""


class InvalidChunkBudgetError(IngestionError):
    """A budget isn't positive."""


class MalformedSourceError(IngestionError):
    """The source has syntax errors."""
