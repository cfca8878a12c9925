"""What can go wrong with an imaging file."""


class ImagingError(Exception):
    """Base of all errors of this package."""


class FormatError(ImagingError, ValueError):
    """The path is not a file or folder of a known kind, or it contradicts itself."""


class DecoderError(ImagingError):
    """No decoder for vendor spectra is at hand, or it failed."""


class DataError(ImagingError, ValueError):
    """What the file holds is missing or contradicts itself: no spectra, an empty axis, a coordinate outside the grid."""


class ConfigurationError(ImagingError, ValueError):
    """An argument or setting that cannot be used."""


class ResourceError(ImagingError):
    """A bound on what a task or the driver may hold would be broken."""
