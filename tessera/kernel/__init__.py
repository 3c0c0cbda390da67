"""The numeric codec: numpy kernels that turn one chunk of numbers into bytes and back."""
