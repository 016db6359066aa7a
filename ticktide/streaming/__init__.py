"""ticktide.streaming"""
