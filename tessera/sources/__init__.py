"""Reading and writing columns: the native page table, files of the codec, raw numbers, audio and text."""
